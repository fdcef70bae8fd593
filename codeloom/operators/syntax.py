"""Symbols and imports from syntax: Python by its own parser, Rust and the
scripts by a lexer that masks strings and comments and matches braces.

A range is `exact-range` where it was closed, else `approximate`.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import IMPORTS, SYMBOLS
from .extract import SYMBOL_PATTERNS, line_imports, line_symbols, without_prefixes

PARSED = ("rust", "typescript", "javascript", "python")


def _lines(text: str) -> list[str]:
    out = text.split("\n")
    if out[-1] == "":
        out.pop()
    return [x.removesuffix("\r") for x in out]


class Source:
    """A text, its mask (strings and comments blanked), its line numbers and one
    table of its brackets: where each is closed and how deep it lies."""

    def __init__(self, lang: str, text: str):
        self.text, self.lines = text, _lines(text)
        self.mask, self.strings = _masked(lang, text)
        self.ends = [m.start() for m in re.finditer("\n", text)]
        self.marks: list[int] = []
        self.before: list[int] = []  # the depth before each mark
        self.partner: dict[int, int] = {}
        held: list[int] = []
        depth = 0
        for m in re.finditer(r"[()\[\]{};]", self.mask):
            self.marks.append(m.start())
            self.before.append(depth)
            if m[0] in "([{":
                held.append(m.start())
                depth += 1
            elif m[0] in ")]}":
                depth -= 1
                if held:
                    self.partner[held.pop()] = m.start()

    def line(self, at: int) -> int:
        return bisect_left(self.ends, at) + 1

    def signature(self, line: int) -> str:
        return self.lines[line - 1].strip()[:180] if line <= len(self.lines) else ""

    def depth(self, at: int) -> int:
        """How many brackets are open at a place, less those closed."""
        k = bisect_left(self.marks, at)
        if k < len(self.marks):
            return self.before[k]
        last = self.mask[self.marks[-1]] if self.marks else ";"
        return (self.before[-1] if self.marks else 0) + (last in "([{") - (last in ")]}")

    def closed(self, at: int, stop: str = ";") -> tuple[int, bool]:
        """Where the body that begins after `at` ends, and whether it does; what
        brackets hold is stepped over."""
        k = bisect_left(self.marks, at)
        while k < len(self.marks):
            i = self.marks[k]
            c = self.mask[i]
            if c in "([{":
                if (end := self.partner.get(i)) is None:
                    break
                if self.mask[end] == "}":
                    return end, True
                k = bisect_left(self.marks, end, k)
            elif c in ")]}" or c in stop:
                return i, True
            k += 1
        return max(at, len(self.mask) - 1), False


def _masked(lang: str, text: str) -> tuple[str, list[tuple[int, str]]]:
    """Strings and comments become spaces; also the plain strings with their places."""
    rust = lang == "rust"
    out, strings, i, n = list(text), [], 0, len(text)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        c = text[i]
        if text.startswith("//", i):
            end = text.find("\n", i)
            end = n if end < 0 else end
            blank(i, end)
        elif text.startswith("/*", i):
            end, depth = i + 2, 1
            while end < n and depth:
                if text.startswith("*/", end):
                    depth, end = depth - 1, end + 2
                elif rust and text.startswith("/*", end):
                    depth, end = depth + 1, end + 2
                else:
                    end += 1
            blank(i, end)
        elif rust and (m := re.compile(r'b?r(#*)"').match(text, i)) and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] == "_")):
            end = text.find('"' + m[1], m.end())
            end = n if end < 0 else end + 1 + len(m[1])
            blank(i, end)
        elif c == '"' or (c in "'`" and not rust):
            end = i + 1
            while end < n and text[end] != c and (c == "`" or text[end] != "\n" or rust):
                end += 2 if text[end] == "\\" else 1
            end = min(end + 1, n)
            strings.append((i, text[i + 1 : end - 1]))
            blank(i, end)
        elif c == "'" and rust and (m := re.compile(r"'(?:\\[^\n]{1,9}?|[^\\'\n])'").match(text, i)):
            end = m.end()
            blank(i, end)
        else:
            end = i + 1
        i = end
    return "".join(out), strings


def _tree(text: str) -> ast.Module | None:
    """What Python's parser makes of a text, or None where it refuses it."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _python_line_symbols(text: str) -> list[tuple]:
    """By line patterns, each up to the line before the next."""
    lines, out = _lines(text), []
    for i, line in enumerate(lines, 1):
        found = next(((m[1], kind) for pattern, kind in SYMBOL_PATTERNS["python"] if (m := re.match(pattern, line))), None)
        if found:
            out.append((*found, i, line.strip()[:180]))
    ends = [x[2] - 1 for x in out[1:]] + [max(len(lines), 1)]
    return [(name, kind, i, max(i, end), "approximate", said) for (name, kind, i, said), end in zip(out, ends)]


def _python_symbols(text: str) -> list[tuple] | None:
    tree, lines, out = _tree(text), _lines(text), []
    if tree is None:
        return None
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            out.append((node.name, kind, node.lineno, node.end_lineno, "exact-range", lines[node.lineno - 1].strip()[:180], node.col_offset))
    return [x[:6] for x in sorted(out, key=lambda x: (x[2], x[6]))]


_RUST = re.compile(r"\b(?:(fn|struct|enum|trait)\s+([A-Za-z_]\w*)|(impl)\b)")
_HEAD = re.compile(r"(?:pub(?:\s*\([^)]*\))?\s+|unsafe\s+|async\s+|const\s+|extern(?:\s+\S+)?\s+|default\s+)*\Z")
_IMPL = re.compile(r"(?:[&!]\s*)?(?:dyn\s+)?((?:[A-Za-z_]\w*\s*::\s*)*[A-Za-z_]\w*)")
_SCRIPT = re.compile(r"\b(?:(function)\s*\*?\s*([A-Za-z_$][\w$]*)|(class|interface)\s+([A-Za-z_$][\w$]*)|(type)\s+([A-Za-z_$][\w$]*)(?:\s*<[^=;]*>)?\s*=(?!=)|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;\n]+)?=\s*(?:async\s+)?(?:(function\b)|(?:\([^;{}]*?\)|[A-Za-z_$][\w$]*)\s*(?::[^=;{]+)?=>))")
_METHOD = re.compile(r"(?:^|(?<=[{};\n]))[ \t]*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*[*#]?([A-Za-z_$][\w$]*)\s*(?:<[^(){}]*>)?\(", re.M)
_NOT_METHODS = frozenset({"if", "for", "while", "switch", "catch", "return", "function", "with", "constructor_"})


def _angles(mask: str, at: int) -> int:
    """The place after the generic arguments that begin at `at`."""
    depth = 0
    for i in range(at, len(mask)):
        depth += (mask[i] == "<") - (mask[i] == ">" and mask[i - 1] not in "-=")
        if depth == 0:
            return i + 1
    return at


def _rust_symbols(source: Source) -> list[tuple]:
    out, mask = [], source.mask
    for m in _RUST.finditer(mask):
        if m[3]:
            at = m.end()
            at += len(mask[at:]) - len(mask[at:].lstrip())
            if mask[at : at + 1] == "<":
                at = _angles(mask, at)
                at += len(mask[at:]) - len(mask[at:].lstrip())
            if not (named := _IMPL.match(mask, at)):
                continue
            end = _angles(mask, named.end()) if mask[named.end() : named.end() + 1] == "<" else named.end()
            name, kind = source.text[named.start(1) : end], "impl"
        else:
            name, kind, end = m[2], {"fn": "function"}.get(m[1], m[1]), m.end()
            if m[1] == "fn" and mask[source.closed(end)[0]] == ";":
                continue  # declared without a body
        begin = m.start()
        begin = _HEAD.search(mask, mask.rfind("\n", 0, begin) + 1, begin).start()
        close, whole = source.closed(end)
        line = source.line(begin)
        out.append((name, kind, line, source.line(close), "exact-range" if whole else "approximate", source.signature(line)))
    return out


def _script_symbols(source: Source) -> list[tuple]:
    out, mask, bodies = [], source.mask, []
    for m in _SCRIPT.finditer(mask):
        kind = m[1] or m[3] or m[5] or "function"
        name = m[2] or m[4] or m[6] or m[7]
        close, whole = source.closed(m.end(), ";" if kind in ("type", "function") and not m[1] else ";" if kind == "function" else "")
        line = source.line(m.start())
        out.append((name, kind, line, source.line(close), "exact-range" if whole else "approximate", source.signature(line)))
        if kind == "class":
            bodies.append((mask.find("{", m.end()), close))
    for a, b in bodies:
        if a < 0:
            continue
        inside = source.depth(a) + 1
        for m in _METHOD.finditer(mask, a + 1, b):
            i = m.start(1)
            if m[1] not in _NOT_METHODS and source.depth(i) == inside:
                close, whole = source.closed(m.end() - 1)
                if mask[close : close + 1] == "}":
                    line = source.line(i)
                    out.append((m[1], "function", line, source.line(close), "exact-range" if whole else "approximate", source.signature(line)))
    return sorted(out, key=lambda x: x[2])


def symbols_of(lang: str, text: str) -> list[tuple] | None:
    """(name, kind, line, end_line, range_evidence, signature), or None without a
    parser or where it refuses the text."""
    if lang == "python":
        return _python_symbols(text)
    if lang == "rust":
        return sorted(_rust_symbols(Source(lang, text)), key=lambda x: x[2])
    return _script_symbols(Source(lang, text)) if lang in PARSED else None


def _file_symbols(lang: str, text: str) -> list[tuple] | None:
    """`symbols_of`, or line patterns where Python's parser refuses the text."""
    found = symbols_of(lang, text)
    return _python_line_symbols(text) if found is None and lang == "python" else found


def _script_imports(source: Source) -> list[tuple]:
    """Each `import` keyword with the module string of its own statement, however
    far, and each `require` of one string."""
    out, mask, strings = [], source.mask, source.strings
    places = [at for at, _ in strings]
    for m in re.finditer(r"(?<![.$])\bimport\b(?!\s*[.(])", mask):
        begin, depth = m.end(), 0
        for k in range(bisect_left(places, m.end()), len(strings)):
            at, said = strings[k]
            between = mask[begin:at]
            if ";" in between:
                break
            depth += between.count("{") - between.count("}")
            if begin == m.end() and not between.strip() or re.search(r"\bfrom\s*\Z", between):
                out.append((said, "import", source.line(m.start())))
                break
            if depth < 1:  # only names in braces may be strings
                break
            begin = at + len(said) + 2
    last = 0
    for at, said in strings:
        if re.search(r"\brequire\s*\(\s*\Z", mask[last:at]) and re.compile(r"\s*\)").match(mask, at + len(said) + 2):
            out.append((said, "require", source.line(at)))
        last = at
    return out


def imports_of(lang: str, text: str) -> list[tuple]:
    """(target, kind, line) from syntax."""
    out: list[tuple] = []
    if lang == "python":
        if (tree := _tree(text)) is None:
            found = []
            for i, line in enumerate(_lines(text), 1):
                if m := re.match(r"\s*from\s+([\w.]+)\s+import\b", line):
                    found.append((m[1], "import", i))
                elif m := re.match(r"\s*import\s+([\w., \t]+)", line):
                    found += [(x.split(" as ")[0].strip(), "import", i) for x in m[1].split(",")]
            return sorted({x for x in found if x[0] and x[0] != "__future__"})
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                out += [(a.name, "import", node.lineno) for a in node.names]
            elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
                out.append(("." * node.level + (node.module or ""), "import", node.lineno))
    elif lang == "rust":
        source = Source(lang, text)
        for m in re.finditer(r"(?:^|(?<=[;{}\n]))\s*((?:pub(?:\s*\([^)]*\))?\s+)?use\s[^;]*);|(?:^|(?<=[;{}\n]))\s*(?:pub(?:\s*\([^)]*\))?\s+)?(mod)\s+([A-Za-z_]\w*)\s*;", source.mask):
            if m[2]:
                out.append((m[3], "module", source.line(m.start(2))))
            else:
                said = source.text[m.start(1) : m.end(1)].strip()
                out.append((said.removeprefix("use ").strip(), "use", source.line(m.start(1))))
    elif lang in ("typescript", "javascript"):
        source = Source(lang, text)
        out += _script_imports(source)
    return sorted({x for x in out if x[0]})


def _extract(fn, schema: str):
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [(path, *x) for path, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3))) for x in fn(lang, text) or ()]
            if rows:
                kinds = [pa.int32() if n in ("line", "end_line") else pa.string() for n in names]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def extract_symbols(files: DataFrame) -> DataFrame:
    """All symbols: by syntax where there is a parser, else by line patterns.
    Every file is read and parsed once."""
    held = files.select("path", "lang", "content")
    parsed = held.where(F.col("lang").isin(*PARSED)).mapInArrow(_extract(_file_symbols, SYMBOLS), SYMBOLS)
    return parsed.unionByName(line_symbols(held.where(~F.col("lang").isin(*PARSED))))


def extract_imports(files: DataFrame) -> DataFrame:
    """All imports: Python by syntax alone, others by syntax and line patterns together."""
    held = files.select("path", "lang", "content")
    parsed = held.where(F.col("lang").isin(*PARSED)).mapInArrow(_extract(imports_of, IMPORTS), IMPORTS)
    return without_prefixes(parsed.unionByName(line_imports(held.where("lang <> 'python'"))).distinct())
