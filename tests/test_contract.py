"""Contract cases of the resolver in four languages, rebuilt from their descriptions,
build orders, changes that arrive one by one, and answers from stored postings."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import rank, resolve, status, syntax
from codeloom.operators.extract import file_lines
from codeloom.plans import reports
from codeloom.sources import gitdiff
from codeloom.sources.store import build_index, refresh_index

# language, files, then source, target as written, kind, line, state, target, candidates
CASES = [
    ("rust", {"src/lib.rs": "mod thing;\n", "src/thing.rs": "pub fn go() {}\n"}, ("src/lib.rs", "thing", "module", 1, "exact", "src/thing.rs", [])),
    ("rust", {"src/lib.rs": "mod thing;\n", "src/thing.rs": "", "src/thing/mod.rs": ""}, ("src/lib.rs", "thing", "module", 1, "ambiguous", None, ["src/thing.rs", "src/thing/mod.rs"])),
    ("rust", {"src/lib.rs": "use std::fs;\n"}, ("src/lib.rs", "std::fs", "use", 1, "unresolved", None, [])),
    ("python", {"pkg/__init__.py": "", "pkg/use.py": "from .local import x\n", "pkg/local.py": "x = 1\n"}, ("pkg/use.py", ".local", "import", 1, "exact", "pkg/local.py", [])),
    ("python", {"app.py": "import pkg.tool\n", "one/pkg/tool.py": "", "two/pkg/tool.py": ""}, ("app.py", "pkg.tool", "import", 1, "ambiguous", None, ["one/pkg/tool.py", "two/pkg/tool.py"])),
    ("python", {"app.py": "import missing.module\n"}, ("app.py", "missing.module", "import", 1, "unresolved", None, [])),
    *((lang, {f"src/app.{e}": line.format("./thing"), f"src/thing.{e}": ""}, (f"src/app.{e}", "./thing", kind, 1, "exact", f"src/thing.{e}", [])) for lang, e, kind, line in (("typescript", "ts", "import", "import {{ a }} from '{}'\n"), ("javascript", "js", "require", "const a = require('{}')\n"))),
    *((lang, {f"src/app.{e}": line.format("./thing"), f"src/thing.{e}": "", f"src/thing/index.{e}": ""}, (f"src/app.{e}", "./thing", kind, 1, "ambiguous", None, [f"src/thing.{e}", f"src/thing/index.{e}"])) for lang, e, kind, line in (("typescript", "ts", "import", "import {{ a }} from '{}'\n"), ("javascript", "js", "require", "const a = require('{}')\n"))),
    *((lang, {f"src/app.{e}": line.format(name)}, (f"src/app.{e}", name, kind, 1, "unresolved", None, [])) for lang, e, name, kind, line in (("typescript", "ts", "react", "import", "import r from '{}'\n"), ("javascript", "js", "fs", "require", "const f = require('{}')\n"))),
]


@pytest.fixture(scope="module")
def contract(spark):
    """All cases side by side, each in a folder whose name no import can spell."""
    files = [(f"case-{i}/{path}", lang, text) for i, (lang, own, _) in enumerate(CASES) for path, text in own.items()]
    table = spark.createDataFrame(files, "path string, lang string, content string").repartition(3)
    imports = syntax.extract_imports(table).collect()
    return table.select("path", "lang").collect(), imports


def edges_of(spark, files, imports):
    return resolve.resolve_imports(spark.createDataFrame(imports, "file_path string, target string, kind string, line int"), spark.createDataFrame(files, "path string, lang string"))


def test_contract_cases(spark, contract):
    edges = edges_of(spark, *contract)
    got = {(e.source_path, e.raw_target): (e.kind, e.line, e.resolution, e.target_path, e.candidate_paths) for e in edges.collect()}
    want, labels = {}, []
    for i, (lang, _, (source, raw, kind, line, state, target, candidates)) in enumerate(CASES):
        at = lambda p: p and f"case-{i}/{p}"  # noqa: B023, E731
        want[at(source), raw] = (kind, line, state, at(target), [at(c) for c in candidates])
        labels.append((lang, at(source), raw, line, state, at(target), [at(c) for c in candidates]))
    assert got == want
    known = spark.createDataFrame(labels, "language string, source_path string, raw_target string, line int, resolution string, expected_target string, candidate_paths array<string>")
    languages = spark.createDataFrame([(x[1], x[0]) for x in labels], "source_path string, language string")
    for m in status.graph_quality(known, edges.join(languages, "source_path")).collect():
        assert (m.wrong_exact, m.precision, m.recall, m.ambiguity_accuracy) == (0, 1.0, 1.0, 1.0)


def test_twenty_build_orders(spark, contract):
    files, imports = contract
    digests = set()
    for run in range(20):
        rnd = random.Random(run)
        digests.add(resolve.edge_digest(edges_of(spark, rnd.sample(files, len(files)), rnd.sample(imports, len(imports)))).first().digest)
    assert len(digests) == 1


SOURCES = {"rs/src/lib.rs": "mod thing;\n", "py/use.py": "from .thing import x\n", "ts/app.ts": "import t from './thing'\n", "js/app.js": "const t = require('./thing')\n"}
TARGETS = {"rs/src/thing.rs": "pub fn t() {}\n", "py/thing.py": "x = 1\n", "ts/thing.ts": "export default 1\n", "js/thing.js": "module.exports = 1\n"}


def test_changes_equal_rebuilds(spark, tmp_path):
    root = tmp_path / "repo"

    def put(files, folder=root):
        for path, text in files.items():
            (folder / path).parent.mkdir(parents=True, exist_ok=True)
            (folder / path).write_text(text)

    def state(index):
        return {e.source_path: (e.resolution, e.target_path) for e in index.edges.collect()}

    put(SOURCES)
    assert set(state(build_index(spark, str(root))).values()) == {("unresolved", None)}
    put(TARGETS)
    added = refresh_index(spark, str(root))
    assert state(added) == {s: ("exact", t) for s, t in zip(SOURCES, TARGETS)}
    for path in TARGETS:
        (root / path).rename((root / path).with_name("moved" + (root / path).suffix))
    renamed = refresh_index(spark, str(root))
    assert set(state(renamed).values()) == {("unresolved", None)}
    digest, mark = resolve.edge_digest(renamed.edges).first(), status.index_fingerprint(renamed.files).first()
    clean = build_index(spark, str(root))
    assert (digest, mark) == (resolve.edge_digest(clean.edges).first(), status.index_fingerprint(clean.files).first())


def test_postings_serve_like_a_scan(spark):
    rnd = random.Random(1)
    words = ["order", "save", "index", "naïve", "x1", "snake_case", "Other", "foo", "bar"]
    files = [(f"src/{rnd.choice(words)}_{i}.md", " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))), "") for i in range(60)] + [("src/tests/foo_bar.md", "foo_bar foo bar", "")]
    table = spark.createDataFrame(files, "path string, content string, symbols string").repartition(3)
    terms, lengths = rank.postings(table)
    for query in ("order naïve", "snake_case order order", "foo_bar", "nothing", "", "é __"):
        for tests in (True, False):
            want = [(r.path, round(r.score, 9)) for r in rank.rank_files(table, query, tests).collect()]
            assert [(r.path, round(r.score, 9)) for r in rank.rank_index(terms, lengths, table, query, tests).collect()] == want


def test_paths_are_decoded_loosely():
    cases = {'"a\\303\\251"': "aé", '"a\\q"': "aq", '"a\\7"': "a\x07", '"\\377"': "\ufffd", '"a': '"a', " plain ": "plain", '"t\\tn\\n\\"\\\\"': 't\tn\n"\\', '"end\\"': "end"}
    assert {k: gitdiff.decode_path(k) for k in cases} == cases


def test_lines(spark):
    texts = ["", "a", "a\n", "a\r\nb\r", "\n\r", "\r\r\n", "a\n\nb", "\u2028\n", "x\r"]
    rows = file_lines(spark.createDataFrame([(t, "l", t) for t in texts], "path string, lang string, content string")).collect()
    for t in texts:
        parts = t.split("\n")
        want = [x.removesuffix("\r") for x in (parts[:-1] if parts[-1] == "" else parts)]
        assert [r.text for r in sorted((r for r in rows if r.path == t), key=lambda r: r.line)] == want


def test_impact_markdown_is_cut_by_rows():
    files = [{"path": f"src/f{i}.ts", "roles": [r], "depth": 1, "evidence": [{"source_path": "a", "line": 1, "raw_target": "x", "resolver": "r"}]} for i, r in enumerate(["pivot"] + ["dependent"] * 30 + ["test"])]
    seen = [{"source": "a", "line": i, "raw_target": "y", "resolution": "unresolved", "resolver": "r"} for i in range(14)]
    result = {"files": files, "unresolved": seen, "truncated": False, "omitted_files": 0, "omitted_observations": 2}
    whole = reports.impact_markdown(result, "T", 4000, "Pivots")
    assert [x for x in whole.split("\n") if x.startswith("#")] == ["# T", "## Pivots", "## Blast radius", "## Likely tests", "## Unresolved or ambiguous observations"]
    assert whole.count("- src/f") == 32 and "- … 4 additional observations omitted\n" in whole and ">" not in whole
    for budget in (64, 100, 200, 500, 600, 700):
        part = reports.impact_markdown(result, "T", budget, "Pivots")
        assert len(part.encode()) <= 4 * budget
        rows = [x for x in part.split("\n") if x.startswith("- src")]
        assert rows == [x for x in whole.split("\n") if x.startswith("- src")][: len(rows)] and len(rows) == part.count("- src/f")


def test_brackets_agree_with_a_walk():
    rnd = random.Random(2)
    for _ in range(60):
        text = "".join(rnd.choice("(){}[]; a\n") for _ in range(rnd.randint(0, 60)))
        source = syntax.Source("rust", text)
        for at in range(len(text) + 1):
            for stop in (";", ""):
                depth, want = 0, (max(at, len(text) - 1), False)
                for i in range(at, len(text)):
                    c = text[i]
                    depth += (c in "([{") - (c in ")]}")
                    if depth < 0 or (c == "}" and depth == 0) or (c == stop and depth == 0):
                        want = (i, True)
                        break
                assert source.closed(at, stop) == want, (text, at, stop)
            assert source.depth(at) == sum((c in "([{") - (c in ")]}") for c in text[:at])


def test_symbols_of_more_languages(spark):
    from codeloom.operators.extract import line_imports, line_symbols

    files = [("a.go", "go", 'import (\n  "fmt"\n)\nfunc (s *S) Run() {\n}\ntype S struct {\ntype I interface {\nfunc Plain() {'), ("b.rb", "ruby", "module M::N\n  class C\n    def ok?\n"), ("C.java", "java", "public class C {\n  public static void main(String[] a) {\n"), ("d.rs", "rust", "pub async fn f() {}\nimpl Show for S {}\nuse a::b;\nmod m;\npub trait T {}"), ("e.py", "python", "async def g():\nclass K:\nimport os, sys as s\nfrom . import x\n")]
    table = spark.createDataFrame(files, "path string, lang string, content string")
    got = {(r.file_path, r.name, r.kind, r.line) for r in line_symbols(table).collect()}
    assert got == {("a.go", "Run", "function", 4), ("a.go", "S", "struct", 6), ("a.go", "I", "interface", 7), ("a.go", "Plain", "function", 8), ("b.rb", "M::N", "module", 1), ("b.rb", "C", "class", 2), ("b.rb", "ok?", "function", 3), ("C.java", "C", "type", 1), ("C.java", "main", "function", 2), ("d.rs", "f", "function", 1), ("d.rs", "S", "impl", 2), ("d.rs", "T", "trait", 5), ("e.py", "g", "function", 1), ("e.py", "K", "class", 2)}
    found = {(r.file_path, r.target, r.kind) for r in line_imports(table).collect()}
    assert found == {("a.go", "fmt", "import"), ("d.rs", "a::b", "use"), ("d.rs", "m", "module"), ("e.py", "os", "import"), ("e.py", "sys", "import"), ("e.py", ".", "import")}
