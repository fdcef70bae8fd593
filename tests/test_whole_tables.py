"""Registered queries read the whole of their tables."""

import os

import duckdb
import pytest

from codeloom.operators import changes, syntax
from codeloom.plans import queries as Q
from codeloom.plans.corpus import code_files, over

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def oracle(sql):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    found = db.execute(sql)
    columns = [d[0] for d in found.description]
    return columns, found.fetchall()


def same(rows, sql):
    columns, want = oracle(sql)
    assert sorted(rows.columns) == sorted(columns)
    assert sorted(str([r[c] for c in columns]) for r in rows.collect()) == sorted(str(list(r)) for r in want)


def test_hunks_cover_every_file(spark):
    files = code_files(spark, SF)
    paths = {r.path for r in files.select("path").collect()}
    assert {(r.path, r.hunk) for r in over(Q.HUNKS, "files", files).collect()} == {(p, h) for p in paths for h in range(3)}
    for name in ("symbol_overlap", "changed_file_flags"):
        same(Q.QUERIES[name](spark, SF), Q.ORACLES[name])
    assert {r.path for r in Q.QUERIES["changed_file_flags"](spark, SF).collect()} == paths | {"gone/x.ts"}


def test_labels_cover_every_edge(spark):
    row = Q.QUERIES["graph_quality_metrics"](spark, SF).first()
    exact = Q.QUERIES["edge_state_counts"](spark, SF).where("resolution = 'exact'").first().n
    assert row.labeled_supported == row.emitted_exact == exact
    assert row.correct_ambiguous == row.labeled_ambiguous and 0 < row.correct_exact < exact
    same(Q.QUERIES["graph_quality_metrics"](spark, SF), Q.ORACLES["graph_quality_metrics"])


def test_file_without_hunks_is_module_level(spark):
    files = spark.createDataFrame([("a.ts",), ("b.ts",)], "path string")
    listed = spark.createDataFrame([("a.ts", "modified", False), ("b.ts", "modified", False)], "path string, kind string, binary boolean")
    hunks = spark.createDataFrame([("a.ts", 0)], "path string, hunk int")
    rows = changes.changed_file_flags(listed, hunks, hunks, files).collect()
    assert {r.path: r.module_level for r in rows} == {"a.ts": False, "b.ts": True}


def test_every_document_is_extracted(spark):
    paths = {r.path for r in code_files(spark, SF).select("path").collect()}
    assert {r.file_path for r in Q.QUERIES["regex_symbols"](spark, SF).select("file_path").collect()} == paths
    assert {r.file_path for r in Q.QUERIES["regex_imports"](spark, SF).select("file_path").collect()} == {p for p in paths if not p.endswith("/index.ts")}
    for name in ("index_status", "reverse_deps"):
        same(Q.QUERIES[name](spark, SF), Q.ORACLES[name])


def ids(spark):
    return {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}


def test_python_over_every_document(spark):
    docs = ids(spark)
    path = lambda i: f"py/m{i % 20}/doc_{i}.py"
    rows = Q.QUERIES["python_symbols_ast"](spark, SF).collect()
    exact = {(r.file_path, r.name, r.kind, r.line, r.end_line) for r in rows if r.range_evidence == "exact-range"}
    assert exact == {x for i in docs for x in ((path(i), f"K_{i}", "class", 6, 8), (path(i), "m", "function", 7, 8), (path(i), f"f_{i}", "function", 10, 11))}
    assert {(r.file_path, r.name, r.line) for r in rows if r.range_evidence == "approximate"} == {(f"py/raw/doc_{i}.py", f"broken_{i}", 1) for i in docs}
    want = set()
    for i in docs:
        near, far = (j if j in docs else None for j in (i + 20, i + 7))
        want |= {(path(i), "os", None, 1), (path(i), f"m{(i + 7) % 20}.doc_{i + 7}", far and path(far), 1), (path(i), f".doc_{i + 20}", near and path(near), 2), (f"py/raw/doc_{i}.py", f"m{i % 20}.doc_{i}", path(i), 2)}
    assert {(r.file_path, r.target, r.line) for r in Q.QUERIES["python_imports_ast"](spark, SF).collect()} == {(a, b, d) for a, b, _, d in want}
    edges = Q.QUERIES["python_edges"](spark, SF).collect()
    assert {(r.source_path, r.raw_target, r.target_path, r.line) for r in edges} == want and len(edges) == len(want)


def test_rust_and_scripts_over_every_document(spark):
    docs = ids(spark)
    path = lambda i: f"rs/src/m{i % 20}/doc_{i}.rs"
    files = {r.path for r in code_files(spark, SF).select("path").collect()}
    rows = Q.QUERIES["brace_language_symbols"](spark, SF).collect()
    assert {(r.file_path, r.name, r.kind, r.line, r.end_line) for r in rows if r.file_path.startswith("rs/")} == {x for i in docs for x in ((path(i), f"A_{i}", "struct", 5, 5), (path(i), "Show", "impl", 6, 8), (path(i), "go", "function", 7, 7))}
    assert {r.file_path for r in rows if not r.file_path.startswith("rs/")} == files
    rows = Q.QUERIES["brace_language_imports"](spark, SF).collect()
    want = {x for i in docs for x in ((path(i), f"crate::m{(i + 7) % 20}::doc_{i + 7}::A", "use", 1, i + 7), (path(i), f"super::doc_{i + 20}::{{A, B}}", "use", 2, i + 20), (path(i), "std::fs", "use", 3, None), (path(i), "inner", "module", 4, None))}
    assert {(r.file_path, r.target, r.kind, r.line) for r in rows if r.file_path.startswith("rs/")} == {x[:4] for x in want}
    assert {r.file_path for r in rows if not r.file_path.startswith("rs/")} == {p for p in files if not p.endswith("/index.ts")}
    edges = Q.QUERIES["rust_edges"](spark, SF).collect()
    assert {(r.source_path, r.raw_target, r.kind, r.line, r.target_path) for r in edges} == {(*x[:4], path(x[4]) if x[4] in docs else None) for x in want}


PY = "import os, a.b as c\nfrom . import x\nfrom ..pkg import (\n  y)\nfrom __future__ import annotations\n@deco\nclass K:\n    async def m(self):\n        pass\n\ndef f():\n    return 1\n"
RS = 'pub struct A { x: i32 }\nimpl<T> Show for A {\n    fn go(&self) -> &\'static str { "}" }\n}\nmod inner;\npub use crate::x::Y;\nuse std::fs;\n'
JS = "import {\n  a } from './a'\nconst r = require('./r')\nclass K {\n  run(x) { return `}` }\n}\nexport const go = async (x) => {\n  return 1\n}\n"


def test_syntax_of_small_texts():
    short = lambda lang, text: [(x[0], x[2], x[3]) for x in syntax.symbols_of(lang, text)]
    assert short("python", PY) == [("K", 7, 9), ("m", 8, 9), ("f", 11, 12)] and syntax.symbols_of("python", "def f(:\n") is None
    assert short("rust", RS) == [("A", 1, 1), ("Show", 2, 4), ("go", 3, 3)]
    assert sorted(short("typescript", JS)) == [("K", 4, 6), ("go", 7, 9), ("run", 5, 5)]
    assert set(syntax.imports_of("python", PY)) == {("os", "import", 1), ("a.b", "import", 1), (".", "import", 2), ("..pkg", "import", 3)}
    assert set(syntax.imports_of("rust", RS)) == {("inner", "module", 5), ("pub use crate::x::Y", "use", 6), ("std::fs", "use", 7)}
    assert set(syntax.imports_of("javascript", JS)) == {("./a", "import", 1), ("./r", "require", 3)}


def test_long_script_imports():
    names = "".join(f"  a_rather_long_name_{i},\n" for i in range(120))
    for lang in ("javascript", "typescript"):
        of = lambda text: set(syntax.imports_of(lang, text))  # noqa: B023, E731
        assert of("import {\n" + names + "} from './x'\n") == {("./x", "import", 1)}
        assert of("const z = 'q';\nimport a /* " + "long " * 1000 + "*/ from './y'\n") == {("./y", "import", 2)}
        assert of("import a from './a'\nimport b from './b'\nimport './c'\nconst s = 'd'\n") == {("./a", "import", 1), ("./b", "import", 2), ("./c", "import", 3)}
        assert of("import{a}from'./m';import'./n'\n") == {("./m", "import", 1), ("./n", "import", 1)}
        assert of("import { 'x-y' as b, c } from './e'\n") == {("./e", "import", 1)}
        assert of("const r = require(/* " + "long " * 1000 + "*/ './f')\nimport('./g')\nconst h = import.meta\n") == {("./f", "require", 1)}


def test_script_imports_of_every_document(spark):
    rows = Q.QUERIES["brace_language_imports"](spark, SF).where("file_path NOT LIKE 'rs/%'").collect()
    want = Q.QUERIES["regex_imports"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted((r.file_path, r.target, r.kind, r.line) for r in want)
