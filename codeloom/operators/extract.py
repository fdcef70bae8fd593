"""Symbols and imports by line patterns, as relational operators.

Every pattern runs inside the scan stage: lines are exploded from their file,
matched by built-in regular expressions, and no shuffle is needed but for the
windows over one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines_of, trimmed

# What a name looks like, and what a line must look like to declare a
# symbol, by language; the first match of a line wins.
_NAME = "[A-Za-z_][A-Za-z0-9_]*"
_JS = "[A-Za-z_$][A-Za-z0-9_$]*"
_JAVA_LIKE = (
    (r"^\s*(?:public|private|protected|internal|static|final|open|func|void|int|str|bool|class|struct|enum|interface|\w+)[\w\s:<>,*&\[\]]+\s+(" + _NAME + r")\s*\(", "function"),
    (r"^\s*(?:public\s+)?(?:class|struct|enum|interface)\s+(" + _NAME + ")", "type"),
)
_SCRIPT = (
    (r"^\s*(?:export\s+)?(?:async\s+)?function\s+(" + _JS + ")", "function"),
    (r"^\s*(?:export\s+)?(?:const|let|var)\s+(" + _JS + r")\s*=\s*(?:async\s*)?\(", "function"),
    (r"^\s*(?:export\s+)?class\s+(" + _JS + ")", "class"),
    (r"^\s*(?:export\s+)?interface\s+(" + _JS + ")", "interface"),
    (r"^\s*(?:export\s+)?type\s+(" + _JS + ")", "type"),
)

SYMBOL_PATTERNS = {
    "rust": (
        (r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(" + _NAME + ")", "function"),
        (r"^\s*(?:pub\s+)?struct\s+(" + _NAME + ")", "struct"),
        (r"^\s*(?:pub\s+)?enum\s+(" + _NAME + ")", "enum"),
        (r"^\s*(?:pub\s+)?trait\s+(" + _NAME + ")", "trait"),
        (r"^\s*(?:pub\s+)?impl(?:\s+.*)?\s+for\s+(" + _NAME + ")", "impl"),
    ),
    "typescript": _SCRIPT,
    "javascript": _SCRIPT,
    "python": ((r"^\s*(?:async\s+)?def\s+(" + _NAME + ")", "function"), (r"^\s*class\s+(" + _NAME + ")", "class")),
    "go": (
        (r"^\s*func\s+(?:\([^)]*\)\s*)?(" + _NAME + ")", "function"),
        (r"^\s*type\s+(" + _NAME + r")\s+struct", "struct"),
        (r"^\s*type\s+(" + _NAME + r")\s+interface", "interface"),
    ),
    "ruby": ((r"^\s*def\s+([A-Za-z_][A-Za-z0-9_!?=]*)", "function"), (r"^\s*class\s+([A-Za-z_][A-Za-z0-9_:]*)", "class"), (r"^\s*module\s+([A-Za-z_][A-Za-z0-9_:]*)", "module")),
    **dict.fromkeys(("java", "csharp", "kotlin", "swift", "cpp", "c"), _JAVA_LIKE),
}

# What a line must look like to import something.
_SCRIPT_IMPORTS = (
    (r"^\s*import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]", "import"),
    (r"^\s*import\s+['\"]([^'\"]+)['\"]", "import"),
    (r"require\(['\"]([^'\"]+)['\"]\)", "require"),
)
IMPORT_PATTERNS = {
    "rust": ((r"^\s*use\s+([^;]+)", "use"), (r"^\s*mod\s+(" + _NAME + r")\s*;", "module")),
    "typescript": _SCRIPT_IMPORTS,
    "javascript": _SCRIPT_IMPORTS,
    "python": ((r"^\s*import\s+([A-Za-z0-9_., \t]+)", "import"), (r"^\s*from\s+([A-Za-z0-9_.]+)\s+import", "import")),
    "go": ((r"^\s*\"([^\"]+)\"", "import"),),
}


#: What any line that matches a pattern of its language holds, to be looked for first.
_SYMBOL_MARKS = {
    "rust": ("fn", "struct", "enum", "trait", "impl"),
    **dict.fromkeys(("typescript", "javascript"), ("function", "const", "let", "var", "class", "interface", "type")),
    "python": ("def", "class"),
    "go": ("func", "type"),
    "ruby": ("def", "class", "module"),
    **dict.fromkeys(("java", "csharp", "kotlin", "swift", "cpp", "c"), ("(", "class", "struct", "enum", "interface")),
}
_IMPORT_MARKS = {"rust": ("use", "mod"), **dict.fromkeys(("typescript", "javascript"), ("import", "require(")), "python": ("import",), "go": ('"',)}


def _marked(marks: dict[str, tuple[str, ...]]):
    """Whether a line holds one of the marks of its language."""
    held, by = F.lit(False), {}
    for lang, own in marks.items():
        by.setdefault(own, []).append(lang)
    for own, langs in by.items():
        some = F.lit(False)
        for mark in own:
            some = some | F.col("text").contains(mark)
        held = held | (F.col("lang").isin(*langs) & some)
    return held


def file_lines(files: DataFrame) -> DataFrame:
    """(path, lang, line, text, n_lines), one row for each line.

    Exploded with nulls kept and dropped after, so that Catalyst does not split
    every text a second time for a filter that it infers.
    """
    rows = files.select("path", "lang", lines_of(F.col("content")).alias("all"))
    return rows.select("path", "lang", F.size("all").alias("n_lines"), F.posexplode_outer("all").alias("at", "text")).where("text IS NOT NULL").select("path", "lang", (F.col("at") + 1).alias("line"), "text", "n_lines")


def line_symbols(files: DataFrame) -> DataFrame:
    """Symbols by line patterns, each up to the line before the next one."""
    lines = file_lines(files.where(F.col("lang").isin(*SYMBOL_PATTERNS))).where(_marked(_SYMBOL_MARKS))
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for lang, patterns in SYMBOL_PATTERNS.items():
        for pattern, label in reversed(patterns):
            hit = (F.col("lang") == lang) & F.col("text").rlike("(?U)" + pattern)
            if label == "function" and lang in ("java", "csharp", "kotlin", "swift", "cpp", "c"):
                hit = (F.col("lang") == lang) & F.col("text").contains("(") & F.col("text").rlike("(?U)" + pattern)
            kind = F.when(hit, label).otherwise(kind)
            name = F.when(hit, F.regexp_extract("text", "(?U)" + pattern, 1)).otherwise(name)
    found = lines.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("name", name)
    following = F.lead("line").over(Window.partitionBy("path").orderBy("line"))
    last = F.greatest("line", F.coalesce(following - 1, F.greatest("n_lines", F.lit(1))))
    return found.select(F.col("path").alias("file_path"), "name", "kind", "line", last.alias("end_line"), F.lit("approximate").alias("range_evidence"), F.substring(trimmed(F.col("text")), 1, 180).alias("signature"))


def line_imports(files: DataFrame) -> DataFrame:
    """Distinct imports by line patterns."""
    lines = file_lines(files.where(F.col("lang").isin(*IMPORT_PATTERNS))).where(_marked(_IMPORT_MARKS))
    none = F.array().cast("array<struct<target: string, kind: string>>")
    found = none

    def matches(pattern: str, kind: str):
        targets = F.regexp_extract_all("text", F.lit("(?U)" + pattern), F.lit(1))
        return F.transform(targets, lambda t: F.struct(t.alias("target"), F.lit(kind).alias("kind")))

    for lang, patterns in IMPORT_PATTERNS.items():
        own = F.concat(*(matches(p, k) for p, k in patterns))
        if lang == "python":  # `import a, b as c` names several
            several = F.flatten(F.transform(own, lambda x: F.transform(F.split(x["target"], ","), lambda t: F.struct(t.alias("target"), x["kind"].alias("kind")))))
            own = F.when(trimmed(F.col("text")).startswith("import "), several).otherwise(own)
        found = F.when(F.col("lang") == lang, own).otherwise(found)
    rows = lines.select("path", "line", F.explode_outer(found).alias("x"))
    target = trimmed(F.substring_index(trimmed(F.col("x.target")), " as ", 1))
    return rows.select(F.col("path").alias("file_path"), target.alias("target"), F.col("x.kind").alias("kind"), "line").where("target <> ''").distinct()


def without_prefixes(imports: DataFrame) -> DataFrame:
    """Drops an import that another of the same file, line and kind extends."""
    together = Window.partitionBy("file_path", "line", "kind")
    longer = F.exists(F.col("__all"), lambda t: (F.length(t) > F.length("target")) & t.startswith(F.col("target")))
    return imports.withColumn("__all", F.collect_set("target").over(together)).where(~longer).drop("__all")


def distinct_targets(imports: DataFrame) -> DataFrame:
    """The sorted distinct targets of each file."""
    return imports.groupBy("file_path").agg(F.array_sort(F.collect_set("target")).alias("targets"))
