"""One query for each operator, and the SQL that another engine runs for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import capsule, changes, impact, policy, rank, resolve, status, syntax
from ..operators.extract import distinct_targets, line_imports, line_symbols, without_prefixes
from ..shared import materialize, shared_dir
from .corpus import CODE_FILES, TEXT_FILES, code_files, over, python_files, rust_files, text_files, values, values_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


# Pieces of SQL for the other engine.
FILES = f"files AS ({CODE_FILES})"
LINES = (
    FILES
    + """, cut AS (SELECT path, lang, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT path, lang, string_split(content, chr(10)) AS l FROM files)),
lines AS (SELECT path, lang, CAST(generate_subscripts(l, 1) AS INT) AS line, regexp_replace(unnest(l), '\\r$', '') AS text, CAST(len(l) AS INT) AS n_lines FROM cut)"""
)
_W = r"[\s]"
IMPORTS = (
    LINES
    + r""", raw AS (
 SELECT path AS file_path, line, unnest(regexp_extract_all(text, '^\s*import\s+.*?\s+from\s+[''"]([^''"]+)[''"]', 1)) AS target, 'import' AS kind FROM lines WHERE lang <> 'python'
 UNION ALL SELECT path, line, unnest(regexp_extract_all(text, '^\s*import\s+[''"]([^''"]+)[''"]', 1)), 'import' FROM lines WHERE lang <> 'python'
 UNION ALL SELECT path, line, unnest(regexp_extract_all(text, 'require\([''"]([^''"]+)[''"]\)', 1)), 'require' FROM lines WHERE lang <> 'python'),
imports AS (SELECT DISTINCT file_path, trim(split_part(trim(target), ' as ', 1)) AS target, kind, line FROM raw WHERE trim(target) <> '')"""
)
SYMBOLS = (
    LINES
    + r""", hit AS (SELECT *, CASE
  WHEN regexp_matches(text, '^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)') THEN 'function'
  WHEN regexp_matches(text, '^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?\(') THEN 'arrow'
  WHEN regexp_matches(text, '^\s*(?:export\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)') THEN 'class'
  WHEN regexp_matches(text, '^\s*(?:export\s+)?interface\s+([A-Za-z_$][A-Za-z0-9_$]*)') THEN 'interface'
  WHEN regexp_matches(text, '^\s*(?:export\s+)?type\s+([A-Za-z_$][A-Za-z0-9_$]*)') THEN 'type' END AS k FROM lines WHERE lang <> 'python'),
symbols AS (SELECT path AS file_path,
  CASE k WHEN 'function' THEN regexp_extract(text, '^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1)
         WHEN 'arrow' THEN regexp_extract(text, '^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1)
         ELSE regexp_extract(text, '^\s*(?:export\s+)?(?:class|interface|type)\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1) END AS name,
  CASE k WHEN 'arrow' THEN 'function' ELSE k END AS kind, line,
  greatest(line, coalesce(lead(line) OVER (PARTITION BY path ORDER BY line) - 1, greatest(n_lines, 1))) AS end_line,
  'approximate' AS range_evidence, substring(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 180) AS signature FROM hit WHERE k IS NOT NULL)"""
)


def _norm(expression: str) -> str:
    """A relative path resolved: one `../` at most, which is all that the corpus has."""
    return f"regexp_replace(regexp_replace({expression}, '/\\./', '/'), '/[^/.]+/\\.\\./', '/')"


EDGES = (
    IMPORTS
    + f""", stem AS (SELECT i.*, {_norm("regexp_replace(file_path, '/[^/]*$', '') || '/' || target")} AS s FROM imports i WHERE target LIKE './%' OR target LIKE '../%'),
prop AS (SELECT DISTINCT t.file_path, t.target, t.kind, t.line, f.path AS c FROM (SELECT *, unnest([s, s || '.ts', s || '.tsx', s || '.js', s || '.jsx', s || '.mjs', s || '.cjs', s || '/index.ts', s || '/index.tsx', s || '/index.js', s || '/index.jsx', s || '/index.mjs', s || '/index.cjs']) AS p FROM stem) t JOIN files f ON f.path = t.p),
cand AS (SELECT file_path, target, kind, line, list_sort(list(c)) AS cs FROM prop GROUP BY ALL),
edges AS (SELECT i.file_path AS source_path, i.target AS raw_target, CASE WHEN len(cs) = 1 THEN cs[1] END AS target_path, i.kind, i.line,
  CASE WHEN len(cs) = 1 THEN 'exact' WHEN len(cs) > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution, 'typescript-relative-v1' AS resolver,
  CASE WHEN len(cs) > 1 THEN cs ELSE [] END AS candidate_paths
  FROM imports i LEFT JOIN cand c ON i.file_path = c.file_path AND i.target = c.target AND i.kind = c.kind AND i.line = c.line)"""
)


def script_imports(spark: SparkSession, sf: str) -> DataFrame:
    return line_imports(code_files(spark, sf))


def script_edges(spark: SparkSession, sf: str) -> DataFrame:
    files = code_files(spark, sf)
    return resolve.resolve_imports(line_imports(files), files.select("path", "lang"))


# --- functions over paths and text -------------------------------------------------

PATHS = [(p,) for p in ("a.rs", "a.TS", "x/y.tsx", "b.mjs", "c.kts", ".json", "d/.yml", "e.toml", "Makefile", "src/h.h", "m.hpp", "a.b/c", "node_modules/x.js", "src/Target/x.rs", "venv-3/a.py", ".claude/worktrees/a.rs", "a/.CLAUDE/Worktrees/b.rs", ".claude/x/worktrees/a.rs", "personal/a.md", "Personal/a.md", "x/personal/a.md", "Cargo.lock", "package-lock.json", "a.min.js", "site.map", "logo.PNG", "src/testing/x.rs", "tests/a.rs", "a/tests/b.rs", "a_test.rs", "x.test.ts", "x.spec.ts", "x.spec.tsx", "builds/a.c", "é/ü.py")]


@query(
    "language_classify",
    f"""WITH p AS {values_sql(PATHS, "path")}, e AS (SELECT path, regexp_extract(path, '[^/]\\.([^./]+)$', 1) AS e FROM p)
SELECT path, CASE WHEN e = 'rs' THEN 'rust' WHEN e IN ('ts', 'tsx') THEN 'typescript' WHEN e IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript' WHEN e = 'py' THEN 'python'
 WHEN e IN ('go', 'java', 'php', 'swift') THEN e WHEN e = 'rb' THEN 'ruby' WHEN e IN ('kt', 'kts') THEN 'kotlin' WHEN e IN ('c', 'h') THEN 'c' WHEN e IN ('cc', 'cpp', 'hpp') THEN 'cpp'
 WHEN e = 'cs' THEN 'csharp' WHEN e = 'md' THEN 'markdown' WHEN e IN ('toml', 'yaml', 'yml', 'json') THEN 'config' ELSE 'unknown' END AS lang FROM e""",
)
def _language(spark, sf):
    return values(spark, PATHS, "path string").withColumn("lang", T.language_of(F.col("path")))


@query(
    "path_exclusion",
    f"""WITH p AS {values_sql(PATHS, "path")}
SELECT path, len(list_filter(string_split(lower(path), '/'), lambda x: list_contains({list(T.SKIPPED_DIRS)}, x) OR regexp_matches(x, '^\\.?venv[-_]'))) > 0
 OR contains('/' || lower(path) || '/', '/.claude/worktrees/') OR split_part(path, '/', 1) = 'personal'
 OR len(list_filter({list(T.SKIPPED_ENDINGS)}, lambda s: ends_with(lower(path), s))) > 0 AS excluded FROM p""",
)
def _excluded(spark, sf):
    return values(spark, PATHS, "path string").withColumn("excluded", T.is_excluded(F.col("path")))


@query("test_path", f"""WITH p AS {values_sql(PATHS, "path")} SELECT path, contains(path, '/test') OR ends_with(path, '_test.rs') OR ends_with(path, '.test.ts') OR ends_with(path, '.spec.ts') AS is_test FROM p""")
def _test_path(spark, sf):
    return values(spark, PATHS, "path string").withColumn("is_test", T.is_test_path(F.col("path")))


NORMAL = [("a/./b", "a/b"), ("a/../b", "b"), ("../a", None), ("a/b/../../c", "c"), ("/x", None), ("a//b", "a/b"), ("a/..", ""), ("a/../../b", None), ("./", ""), (".", "")]


@query("path_normalize", f"SELECT path, normal FROM {values_sql(NORMAL, 'path, normal')} v")
def _normalize(spark, sf):
    return values(spark, [(p,) for p, _ in NORMAL], "path string").withColumn("normal", T.normalized_path(F.col("path")))


RELATIVE = [("/r/a\\b.rs", "a/b.rs"), ("/r/x/y.py", "x/y.py")]


@query("relative_path", f"SELECT path, rel FROM {values_sql(RELATIVE, 'path, rel')} v")
def _relative(spark, sf):
    return values(spark, [(p,) for p, _ in RELATIVE], "path string").withColumn("rel", T.relative_path(F.col("path"), "/r"))


@query("content_hash", f"WITH {FILES} SELECT path, sha256(content) AS hash FROM files")
def _hash(spark, sf):
    return code_files(spark, sf).select("path", T.content_hash(F.col("content")).alias("hash"))


@query("token_estimate", "SELECT doc_id, greatest(CAST(strlen(text) // 4 AS BIGINT), 1) AS tokens FROM documents")
def _tokens(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query("line_split", f"WITH {LINES} SELECT path, CAST(count(*) AS BIGINT) AS n, CAST(sum(line * length(text)) AS BIGINT) AS mark FROM lines GROUP BY path")
def _lines(spark, sf):
    from ..operators.extract import file_lines

    return file_lines(code_files(spark, sf)).groupBy("path").agg(F.count("*").alias("n"), F.sum(F.col("line") * F.length("text")).cast("bigint").alias("mark"))


# --- extraction -------------------------------------------------------------------

_SYMBOL_COLUMNS = "file_path, name, kind, line, end_line, range_evidence, signature"


@query("regex_symbols", f"WITH {SYMBOLS} SELECT file_path, name, kind, line, range_evidence, signature FROM symbols")
def _symbols(spark, sf):
    return line_symbols(code_files(spark, sf)).drop("end_line")


@query("symbol_ranges", f"WITH {SYMBOLS} SELECT file_path, name, line, end_line FROM symbols")
def _ranges(spark, sf):
    return line_symbols(code_files(spark, sf)).select("file_path", "name", "line", "end_line")


@query("regex_imports", f"WITH {IMPORTS} SELECT file_path, target, kind, line FROM imports")
def _imports(spark, sf):
    return script_imports(spark, sf)


@query("import_targets", f"WITH {IMPORTS} SELECT file_path, list_sort(list(DISTINCT target)) AS targets FROM imports GROUP BY file_path")
def _targets(spark, sf):
    return distinct_targets(script_imports(spark, sf))


RAW_IMPORTS = [("a.rs", "crate::a", "use", 3), ("a.rs", "crate::a::B", "use", 3), ("a.rs", "crate::a", "use", 4), ("a.rs", "crate::a::B", "module", 3), ("b.rs", "x", "use", 1), ("b.rs", "xy", "use", 1), ("b.rs", "xyz", "use", 1)]


@query(
    "import_prefix_suppression",
    f"""WITH i AS {values_sql(RAW_IMPORTS, "file_path, target, kind, line")} SELECT * FROM i a WHERE NOT EXISTS (SELECT 1 FROM i b WHERE a.file_path = b.file_path AND a.line = b.line AND a.kind = b.kind AND length(b.target) > length(a.target) AND starts_with(b.target, a.target))""",
)
def _suppressed(spark, sf):
    return without_prefixes(values(spark, RAW_IMPORTS, "file_path string, target string, kind string, line int"))


# Syntax has no SQL in the other engine; brute-force tests are in tests/test_whole_tables.py.


@query("python_symbols_ast")
def _ast(spark, sf):
    return syntax.extract_symbols(python_files(spark, sf))


@query("python_imports_ast")
def _ast_imports(spark, sf):
    return syntax.extract_imports(python_files(spark, sf))


def _brace_files(spark, sf):
    return code_files(spark, sf).drop("hash").unionByName(rust_files(spark, sf))


@query("brace_language_symbols")
def _braces(spark, sf):
    return syntax.extract_symbols(_brace_files(spark, sf))


@query("brace_language_imports")
def _brace_imports(spark, sf):
    return syntax.extract_imports(_brace_files(spark, sf))


# --- resolution -------------------------------------------------------------------

_EDGE_COLUMNS = "source_path, raw_target, target_path, kind, line, resolution, resolver, candidate_paths"


@query("resolve_relative", f"WITH {EDGES} SELECT {_EDGE_COLUMNS} FROM edges")
def _relative_edges(spark, sf):
    return script_edges(spark, sf)


@query("edge_state_counts", f"WITH {EDGES} SELECT resolution, count(*) AS n FROM edges GROUP BY resolution")
def _states(spark, sf):
    return script_edges(spark, sf).groupBy("resolution").agg(F.count("*").alias("n"))


PY_FILES = [(p, "python") for p in ("app.py", "pkg/use.py", "pkg/local.py", "pkg/__init__.py", "one/pkg/tool.py", "two/pkg/tool.py", "three/solo/__init__.py", "deep/a/b/c.py", "deep/a/x.py")]
PY_IMPORTS = [("app.py", t, "import", i + 1) for i, t in enumerate(("pkg.tool", "missing.module", "solo", "local", "pkg", "tool", "b.c", "a.x"))] + [("pkg/use.py", ".local", "import", 1), ("pkg/use.py", ".", "import", 2), ("pkg/use.py", "..app", "import", 3), ("pkg/use.py", "...app", "import", 4), ("deep/a/b/c.py", "..x", "import", 1)]


@query(
    "resolve_suffix",
    f"""WITH f AS {values_sql(PY_FILES, "path, lang")}, i AS {values_sql(PY_IMPORTS, "file_path, target, kind, line")},
m AS (SELECT *, replace(target, '.', '/') AS m FROM i WHERE NOT starts_with(target, '.')),
c AS (SELECT m.file_path, m.target, m.line, list_sort(list(f.path) FILTER (WHERE f.path IS NOT NULL)) AS c FROM m LEFT JOIN f ON ends_with('/' || f.path, '/' || m.m || '.py') OR ends_with('/' || f.path, '/' || m.m || '/__init__.py') GROUP BY ALL)
SELECT file_path AS source_path, target AS raw_target, CASE WHEN len(c) = 1 THEN c[1] END AS target_path, line, CASE WHEN coalesce(len(c), 0) = 0 THEN 'unresolved' WHEN len(c) = 1 THEN 'exact' ELSE 'ambiguous' END AS resolution, CASE WHEN len(c) > 1 THEN c ELSE [] END AS candidate_paths FROM c
UNION ALL SELECT * FROM (VALUES ('pkg/use.py', '.local', 'pkg/local.py', 1, 'exact', []), ('pkg/use.py', '.', NULL, 2, 'unresolved', []), ('pkg/use.py', '..app', 'app.py', 3, 'exact', []), ('pkg/use.py', '...app', NULL, 4, 'unresolved', []), ('deep/a/b/c.py', '..x', 'deep/a/x.py', 1, 'exact', []))""",
)
def _suffix(spark, sf):
    out = resolve.resolve_imports(values(spark, PY_IMPORTS, "file_path string, target string, kind string, line int"), values(spark, PY_FILES, "path string, lang string"))
    return out.drop("kind", "resolver")


RS_FILES = [(p, "rust") for p in ("src/lib.rs", "src/main.rs", "src/thing.rs", "src/a/mod.rs", "src/a/b.rs", "src/a/b/c.rs", "src/two.rs", "src/two/mod.rs", "other/src/lib.rs")]
# what each Rust import means: source, raw target, kind, line, target, state, candidates
RS_CASES = [
    ("src/lib.rs", "thing", "module", 1, "src/thing.rs", "exact", []),
    ("src/lib.rs", "two", "module", 2, None, "ambiguous", ["src/two.rs", "src/two/mod.rs"]),
    ("src/lib.rs", "std::fs", "use", 3, None, "unresolved", []),
    ("src/lib.rs", "crate::a::b::Item", "use", 4, "src/a/b.rs", "exact", []),
    ("src/lib.rs", "crate::a::*", "use", 5, "src/a/mod.rs", "exact", []),
    ("src/lib.rs", "crate::*", "use", 6, None, "unresolved", []),
    ("src/lib.rs", "crate::{a,b}", "use", 7, None, "ambiguous", ["src/lib.rs", "src/main.rs"]),
    ("src/a/b.rs", "c", "module", 1, "src/a/b/c.rs", "exact", []),
    ("src/a/b.rs", "self::c::X", "use", 2, "src/a/b/c.rs", "exact", []),
    ("src/a/b.rs", "self::X", "use", 3, "src/a/b.rs", "exact", []),
    ("src/a/b.rs", "super::X", "use", 4, "src/a/mod.rs", "exact", []),
    ("src/a/b.rs", "super::super::thing::T", "use", 5, "src/thing.rs", "exact", []),
    ("src/a/b.rs", "super::*", "use", 6, None, "unresolved", []),
    ("other/src/lib.rs", "crate::X", "use", 1, "other/src/lib.rs", "exact", []),
    ("src/lib.rs", "pub use crate::a", "use", 8, None, "unresolved", []),
]


@query("resolve_longest_prefix", f"SELECT source_path, raw_target, kind, line, target_path, resolution, CASE WHEN candidates = '' THEN [] ELSE string_split(candidates, ',') END AS candidate_paths FROM {values_sql([(*c[:6], ','.join(c[6])) for c in RS_CASES], 'source_path, raw_target, kind, line, target_path, resolution, candidates')} v")
def _longest(spark, sf):
    return resolve.resolve_imports(values(spark, [c[:4] for c in RS_CASES], "file_path string, target string, kind string, line int"), values(spark, RS_FILES, "path string, lang string")).drop("resolver")


@query("python_edges")
def _python_edges(spark, sf):
    """The Python resolver over all files of the corpus; brute-force test as above."""
    files = python_files(spark, sf)
    return resolve.resolve_imports(syntax.extract_imports(files), files.select("path", "lang"))


@query("rust_edges")
def _rust_edges(spark, sf):
    """The Rust resolver over all files of the corpus; brute-force test as above."""
    files = rust_files(spark, sf)
    return resolve.resolve_imports(syntax.extract_imports(files), files.select("path", "lang"))


@query("forward_deps", f"WITH {EDGES} SELECT DISTINCT source_path AS path, target_path AS neighbour FROM edges WHERE resolution = 'exact'")
def _forward(spark, sf):
    return resolve.neighbours(script_edges(spark, sf))


@query("reverse_deps", f"WITH {EDGES} SELECT DISTINCT target_path AS path, source_path AS neighbour FROM edges WHERE resolution = 'exact'")
def _reverse(spark, sf):
    return resolve.neighbours(script_edges(spark, sf), reverse=True)


_HASHED = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4))


@query("edge_digest", f"WITH {EDGES}, h AS (SELECT sha256(concat_ws(chr(0), source_path, raw_target, coalesce(target_path, ''), kind, CAST(line AS VARCHAR), resolution, resolver, array_to_string(candidate_paths, chr(1)))) AS h FROM edges) SELECT sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {_HASHED})) AS digest FROM h")
def _digest(spark, sf):
    return resolve.edge_digest(script_edges(spark, sf))


# --- ranking ----------------------------------------------------------------------

QUERY = "thinat cher vequdé que"


def _bm25_sql(terms: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(terms))
    idf = ", ".join(f"CASE WHEN ln((n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) > 0 THEN ln((n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) ELSE 0.000001::DOUBLE END AS i{i}" for i in range(len(terms)))
    df = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END)::DOUBLE AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"i{i} * f{i}::DOUBLE * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg))" for i in range(len(terms)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""WITH files AS ({TEXT_FILES}), tok AS (SELECT path, list_filter(regexp_split_to_array(lower(strip_accents(path || ' ' || content || ' ' || symbols)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM files),
c AS (SELECT path, len(t)::DOUBLE AS len, {tf} FROM tok), s AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avg, {df} FROM c), w AS (SELECT n, avg, {idf} FROM s),
ranked AS (SELECT path, {score} AS score FROM c, w WHERE {some})"""


_TERMS = ["thinat", "cher", "vequde", "que"]
_TOP = "top AS (SELECT path, score FROM ranked ORDER BY score DESC, path LIMIT 80)"
_BOOSTED = _TOP + ", boosted AS (SELECT path, score + {boost} AS score FROM top WHERE {keep})"


@query("bm25_rank_top80", f"{_bm25_sql(_TERMS)}, {_TOP} SELECT path, round(score, 6) AS score FROM top")
def _bm25(spark, sf):
    return rank.bm25(text_files(spark, sf), QUERY).orderBy(F.desc("score"), "path").limit(rank.CANDIDATES).select("path", F.round("score", 6).alias("score"))


@query("bm25_path_boost", f"""{_bm25_sql(["thinat", "m7"])}, {_BOOSTED.format(boost="CASE WHEN contains(lower(path), 'thinat') THEN 4.0 ELSE 0.0 END::DOUBLE + CASE WHEN contains(lower(path), 'm7') THEN 4.0 ELSE 0.0 END::DOUBLE", keep="NOT contains(path, '/test')")} SELECT path, round(score, 6) AS score FROM boosted""")
def _boost(spark, sf):
    return rank.rank_files(text_files(spark, sf), "thinat m7", include_tests=False).select("path", F.round("score", 6).alias("score"))


@query("bm25_duplicate_terms", f"{_bm25_sql(['thinat', 'thinat', 'und'])}, {_TOP} SELECT path, round(score, 6) AS score FROM top")
def _duplicates(spark, sf):
    return rank.bm25(text_files(spark, sf), "thinat Thinat und").orderBy(F.desc("score"), "path").limit(rank.CANDIDATES).select("path", F.round("score", 6).alias("score"))


@query("bm25_from_postings", ORACLES["bm25_rank_top80"])
def _postings(spark, sf):
    return rank.rank_postings(*rank.postings(text_files(spark, sf)), QUERY).select("path", F.round("score", 6).alias("score"))


_HAY = "lower(concat_ws(chr(10), f.path, f.content, coalesce(s.s, ''), coalesce(i.i, '')))"
_SCAN = " + ".join(f"(length({_HAY}) - length(replace({_HAY}, '{t}', '')))::DOUBLE / {len(t)} + CASE WHEN contains(lower(f.path), '{t}') THEN 4.0 ELSE 0.0 END::DOUBLE + CASE WHEN contains(lower(coalesce(s.s, '')), '{t}') THEN 6.0 ELSE 0.0 END::DOUBLE" for t in ("doc_1", "twin"))


@query(
    "scan_rank",
    f"""WITH {SYMBOLS}, {IMPORTS[len(LINES) + 2 :]}, s AS (SELECT file_path, string_agg(concat_ws(' ', kind, name, signature), chr(10)) AS s FROM symbols GROUP BY 1), i AS (SELECT file_path, string_agg(target, chr(10) ORDER BY target) AS i FROM imports GROUP BY 1),
r AS (SELECT f.path, {_SCAN} AS score FROM files f LEFT JOIN s ON s.file_path = f.path LEFT JOIN i ON i.file_path = f.path) SELECT path, round(score, 6) AS score FROM r WHERE score > 0""",
)
def _scan(spark, sf):
    files = code_files(spark, sf)
    return rank.scan_rank(files, line_symbols(files), line_imports(files), "doc_1 twin").select("path", F.round("score", 6).alias("score"))


# --- capsules ---------------------------------------------------------------------

HEADER = 24


def _ranked_texts(spark, sf):
    return rank.rank_files(text_files(spark, sf), QUERY)


def _full_sections(spark, sf):
    files = text_files(spark, sf)
    rows = rank.rank_files(files, QUERY).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))
    return rows.join(files.select("path", F.col("content").alias("section")), "path")


_RANK = _bm25_sql(_TERMS) + ", " + _TOP + ", sec AS (SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM top), secs AS (SELECT sec.*, greatest(strlen(content) // 4, 1)::BIGINT AS t FROM sec JOIN files USING (path)), used AS (SELECT *, sum(t) OVER (ORDER BY rank)::BIGINT + 24 AS used FROM secs)"


@query("capsule_budget_prefix", f"{_RANK} SELECT path, rank, round(score, 6) AS score, t AS estimated_tokens, used FROM used WHERE rank <= 24 AND used <= 8000")
def _budget(spark, sf):
    return capsule.budgeted(_full_sections(spark, sf), 8000, 24, HEADER).select("path", "rank", F.round("score", 6).alias("score"), "estimated_tokens", "used")


@query("capsule_pointers", f"{_RANK} SELECT path, rank, round(score, 6) AS score, 'lexical_index' AS source, 'advisory' AS confidence, 'lexical path, source, or symbol match' AS reason, t AS estimated_tokens FROM used WHERE rank <= 8 AND used <= 2400")
def _pointers(spark, sf):
    return capsule.pointers(capsule.budgeted(_full_sections(spark, sf), 2400, 8, HEADER)).withColumn("score", F.round("score", 6))


@query("capsule_omissions", f"{_RANK}, k AS (SELECT (SELECT count(*) FROM sec) AS n, (SELECT count(*) FROM used WHERE rank <= 24 AND used <= 8000) AS k), o AS (SELECT 'token_budget' AS reason, least(24, n) - k AS count FROM k UNION ALL SELECT 'file_limit', greatest(n - 24, 0) FROM k) SELECT reason, count FROM o WHERE count > 0")
def _omissions(spark, sf):
    rows = _full_sections(spark, sf)
    return capsule.omissions(rows, capsule.budgeted(rows, 8000, 24, HEADER), 24)


@query(
    "best_excerpt",
    f"""WITH {LINES}, s AS (SELECT *, (CASE WHEN contains(lower(text), 'thinat') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'doc_1') THEN 1 ELSE 0 END) AS s FROM lines),
b AS (SELECT path, arg_min(line, (-s, line)) AS at FROM s WHERE s > 0 GROUP BY path) SELECT l.path, l.line, l.text FROM lines l JOIN b ON l.path = b.path AND l.line BETWEEN b.at - 1 AND b.at + 1""",
)
def _excerpt(spark, sf):
    return capsule.best_lines(code_files(spark, sf), "thinat doc_1", 2)


@query(
    "compact_skeleton",
    f"""WITH {SYMBOLS}, {IMPORTS[len(LINES) + 2 :]}, s AS (SELECT file_path, list(kind || ' ' || name ORDER BY line) AS s FROM symbols GROUP BY 1), i AS (SELECT file_path, list(DISTINCT target ORDER BY target) AS i FROM imports GROUP BY 1)
SELECT path, CASE WHEN len(i) > 0 THEN 'Imports: ' || array_to_string(CASE WHEN len(i) > 8 THEN i[:8] || ['...'] ELSE i END, ', ') || chr(10) ELSE '' END
 || CASE WHEN len(s) > 0 THEN 'Symbols: ' || array_to_string(CASE WHEN len(s) > 24 THEN s[:24] || ['...'] ELSE s END, ', ') || chr(10) ELSE 'Symbols: none' || chr(10) END AS skeleton
FROM files f LEFT JOIN s ON s.file_path = f.path LEFT JOIN i ON i.file_path = f.path""",
)
def _compact(spark, sf):
    files = code_files(spark, sf)
    return capsule.compact_skeletons(files, line_symbols(files), line_imports(files))


@query(
    "full_skeleton",
    f"""WITH {SYMBOLS}, {IMPORTS[len(LINES) + 2 :]}, s AS (SELECT file_path, string_agg('- `' || kind || '` ' || name || ' at line ' || line || chr(10) || '  `' || signature || '`' || chr(10), '' ORDER BY line) AS s FROM symbols GROUP BY 1), i AS (SELECT file_path, string_agg('- `' || target || '`' || chr(10), '' ORDER BY target) AS i FROM (SELECT DISTINCT file_path, target FROM imports) GROUP BY 1)
SELECT path, '# Skeleton: ' || path || chr(10) || chr(10) || coalesce('## Imports' || chr(10) || chr(10) || i || chr(10), '') || '## Symbols' || chr(10) || chr(10) || coalesce(s, '*No symbols detected.*' || chr(10)) AS skeleton
FROM files f LEFT JOIN s ON s.file_path = f.path LEFT JOIN i ON i.file_path = f.path""",
)
def _full(spark, sf):
    files = code_files(spark, sf)
    return capsule.skeletons(files, line_symbols(files), line_imports(files))


# --- impact -----------------------------------------------------------------------

_PIVOTS = [("src/m7/doc_27.ts", 0, 2.5), ("src/m0/doc_60.ts", 1, 1.0)]


def _impact_sql(directions: set[str], depth: int, cap: int, tests: bool, last: str = "SELECT * FROM answer") -> str:
    """Files, roles, depths and the number of edges of evidence, by levels with row numbers."""
    omitted = []
    out = [f"WITH {EDGES}", f"piv AS {values_sql(_PIVOTS, 'path, ord, score')}", "f0 AS (SELECT path FROM piv)"]
    test = "(contains({0}, '/test') OR ends_with({0}, '_test.rs') OR ends_with({0}, '.test.ts') OR ends_with({0}, '.spec.ts'))"
    files, evidence = "f0", []
    for d, (role, a, b, order) in enumerate((("dependency", "source_path", "target_path", "target_path, source_path"), ("dependent", "target_path", "source_path", "source_path, target_path"))):
        if not (role in directions or (d and "test" in directions)):
            continue
        keep = "TRUE" if tests and "test" in directions else "NOT " + test.format(b)
        out.append(f"ed{d} AS (SELECT {a} AS src, {b} AS n, source_path, target_path, line, raw_target, row_number() OVER (PARTITION BY {a} ORDER BY {order}, raw_target, line) AS ord FROM edges WHERE resolution = 'exact' AND {keep})")
        out.append(f"s{d}_0 AS (SELECT path, 0 AS depth, ord + 1 AS pos FROM piv)")
        seen = [f"s{d}_0"]
        for k in range(1, depth + 1):
            before = " UNION ALL ".join(f"SELECT path FROM {s}" for s in seen)
            out.append(f"s{d}_{k} AS (SELECT path, {k} AS depth, row_number() OVER (ORDER BY pp, eo) AS pos FROM (SELECT e.n AS path, min(s.pos * 100000 + e.ord) AS k, arg_min(s.pos, s.pos * 100000 + e.ord) AS pp, arg_min(e.ord, s.pos * 100000 + e.ord) AS eo FROM s{d}_{k - 1} s JOIN ed{d} e ON e.src = s.path WHERE e.n NOT IN ({before}) GROUP BY e.n))")
            seen.append(f"s{d}_{k}")
        rep = "TRUE" if role in directions else test.format("{0}")
        out.append(f"seen{d} AS ({' UNION ALL '.join(f'SELECT * FROM {s}' for s in seen)})")
        omitted.append(f"SELECT path FROM seen{d} WHERE depth > 0 AND {rep.format('path')}")
        out.append(f"adm{d} AS (SELECT path FROM (SELECT path, row_number() OVER (ORDER BY depth, pos) AS r FROM seen{d} WHERE depth > 0 AND {rep.format('path')} AND path NOT IN (SELECT path FROM {files})) WHERE r <= {cap} - (SELECT count(*) FROM {files}))")
        out.append(f"g{d} AS (SELECT path FROM {files} UNION ALL SELECT path FROM adm{d})")
        files = f"g{d}"
        evidence.append(f"SELECT e.n AS path, s.depth + 1 AS depth, CASE WHEN {test.format('e.n')} THEN 'test' ELSE '{role}' END AS role, struct_pack(a := source_path, b := target_path, c := line, d := raw_target) AS ev FROM seen{d} s JOIN ed{d} e ON e.src = s.path WHERE s.depth < {depth} AND {rep.format('e.n')}")
    out.append(f"ev AS (SELECT path, 0 AS depth, 'pivot' AS role, NULL AS ev FROM piv UNION ALL {' UNION ALL '.join(evidence)})")
    final = f"SELECT path, list_sort(list(DISTINCT role)) AS roles, min(depth)::INT AS depth, count(DISTINCT ev)::BIGINT AS n_evidence FROM ev WHERE path IN (SELECT path FROM {files}) GROUP BY path"
    out += [f"answer AS ({final})", f"omitted AS (SELECT DISTINCT path FROM ({' UNION ALL '.join(omitted)}) WHERE path NOT IN (SELECT path FROM {files}))"]
    return ", ".join(out) + " " + last


def _impact(directions: set[str], depth: int, cap: int, tests: bool):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        edges = materialize(script_edges(spark, sf), "edges")
        files, _ = impact.impact(edges, values(spark, _PIVOTS, "path string, ord int, score double"), directions, depth, cap, tests)
        return files.select("path", F.array_sort("roles").alias("roles"), "depth", F.size("evidence").cast("bigint").alias("n_evidence"))

    return run


_BOTH = {"dependency", "dependent", "test"}
for _name, _args in {
    "impact_depth1": (_BOTH, 1, 500, True),
    "impact_depth2": (_BOTH, 2, 500, True),
    "impact_depth3": (_BOTH, 3, 500, True),
    "impact_capped": (_BOTH, 3, 6, True),
    "impact_roles": ({"dependency"}, 3, 500, False),
    "impact_tests_only": ({"test"}, 3, 500, True),
}.items():
    query(_name, _impact_sql(*_args))(_impact(*_args))


def _both(spark: SparkSession, sf: str, depth: int, cap: int) -> tuple[DataFrame, DataFrame]:
    edges = materialize(script_edges(spark, sf), "edges")
    return impact.impact(edges, values(spark, _PIVOTS, "path string, ord int, score double"), _BOTH, depth, cap, True)


@query("impact_omitted", _impact_sql(_BOTH, 3, 6, True, "SELECT path FROM omitted"))
def _omitted(spark, sf):
    return _both(spark, sf, 3, 6)[1]


_FIRST_ROLE = "CASE WHEN list_contains(roles, 'pivot') THEN 1 WHEN list_contains(roles, 'dependency') THEN 2 WHEN list_contains(roles, 'dependent') THEN 3 ELSE 4 END"


@query("impact_order", _impact_sql(_BOTH, 3, 500, True, f"SELECT path, row_number() OVER (ORDER BY {_FIRST_ROLE}, depth, score DESC NULLS LAST, path) AS place FROM answer LEFT JOIN piv USING (path)"))
def _order(spark, sf):
    """The order of the answer: at most 500 rows, numbered as they come."""
    rows = impact.in_order(_both(spark, sf, 3, 500)[0]).select("path").collect()
    return values(spark, [(r.path, i) for i, r in enumerate(rows, 1)], "path string, place long")


@query("impact_observations", f"WITH {EDGES}, piv AS {values_sql(_PIVOTS + [('src/m3/doc_3.ts', 2, 0.0), ('src/m13/doc_993.ts', 3, 0.0)], 'path, ord, score')} SELECT source_path AS source, raw_target, kind, line, resolution, candidate_paths AS candidates FROM edges WHERE resolution <> 'exact' AND source_path IN (SELECT path FROM piv) ORDER BY resolution, source, line, raw_target LIMIT 50")
def _observations(spark, sf):
    pivots = values(spark, _PIVOTS + [("src/m3/doc_3.ts", 2, 0.0), ("src/m13/doc_993.ts", 3, 0.0)], "path string, ord int, score double")
    return impact.observations(script_edges(spark, sf), pivots).limit(impact.OBSERVATIONS).drop("resolver")


# --- diffs ------------------------------------------------------------------------

HEADERS = [("@@ -1,2 +3,4 @@",), ("@@ -5 +6 @@ fn x",), ("@@ -7,0 +8,2 @@",), ("@@ -9,3 +8,0 @@",)]


@query("hunk_ranges", f"""WITH h AS {values_sql(HEADERS, "header")}, p AS (SELECT header, regexp_extract(header, '-(\\d+)', 1)::INT AS a, coalesce(nullif(regexp_extract(header, '-\\d+,(\\d+)', 1), '')::INT, 1) AS b, regexp_extract(header, '\\+(\\d+)', 1)::INT AS c, coalesce(nullif(regexp_extract(header, '\\+\\d+,(\\d+)', 1), '')::INT, 1) AS d FROM h)
SELECT header, CASE WHEN b > 0 THEN a END AS old_start, CASE WHEN b > 0 THEN a + b - 1 END AS old_end, CASE WHEN d > 0 THEN c END AS new_start, CASE WHEN d > 0 THEN c + d - 1 END AS new_end FROM p""")
def _hunks(spark, sf):
    return changes.hunk_ranges(values(spark, HEADERS, "header string"))


#: Hunks over the corpus: one near the top and one further down of every file, and one of deletions only.
HUNKS = """SELECT path, h AS hunk, CASE WHEN h = 2 THEN 3 END AS old_start, CASE WHEN h = 2 THEN 3 END AS old_end, CASE WHEN h = 0 THEN 1 WHEN h = 1 THEN 3 END AS new_start, CASE WHEN h = 0 THEN 2 WHEN h = 1 THEN 9 END AS new_end
FROM files, (SELECT 0 AS h UNION ALL SELECT 1 UNION ALL SELECT 2) AS hs"""


def _changed(spark, sf):
    files = code_files(spark, sf)
    hunks = over(HUNKS, "files", files)
    ranges = changes.symbol_ranges(files, line_symbols(files))
    return files, hunks, changes.hunk_overlaps(hunks, ranges)


_OVERLAP = f"WITH {SYMBOLS}, hunks AS ({HUNKS}), over AS (SELECT h.path, h.hunk, s.name, s.kind, s.line AS start, s.end_line AS \"end\" FROM hunks h JOIN symbols s ON s.file_path = h.path AND coalesce(new_start, old_start) <= s.end_line AND s.line <= coalesce(new_end, old_end))"


@query("symbol_overlap", f'{_OVERLAP} SELECT path, hunk, name, kind, start, "end" FROM over')
def _overlap(spark, sf):
    return _changed(spark, sf)[2].drop("range_evidence")


@query("narrowest_symbol", f'{_OVERLAP}, r AS (SELECT *, rank() OVER (PARTITION BY path, hunk ORDER BY "end" - start) AS r FROM over) SELECT DISTINCT path, name, kind, start, "end" FROM r WHERE r = 1')
def _narrowest(spark, sf):
    return changes.narrowest_symbols(_changed(spark, sf)[2]).drop("range_evidence")


@query("changed_file_flags", f"""{_OVERLAP}, c AS (SELECT DISTINCT path FROM hunks UNION ALL SELECT 'gone/x.ts' UNION ALL SELECT 'src/m0/doc_0.ts'), m AS (SELECT h.path, bool_or(o.path IS NULL) AS missed FROM (SELECT DISTINCT path, hunk FROM hunks) h LEFT JOIN (SELECT DISTINCT path, hunk FROM over) o ON o.path = h.path AND o.hunk = h.hunk GROUP BY h.path)
SELECT c.path, f.path IS NULL OR coalesce(m.missed, TRUE) AS module_level, f.path IS NULL AS unindexed, c.path = 'gone/x.ts' AS deleted, FALSE AS binary FROM c LEFT JOIN m ON m.path = c.path LEFT JOIN files f ON f.path = c.path""")
def _flags(spark, sf):
    files, hunks, over = _changed(spark, sf)
    listed = hunks.select("path").distinct().unionByName(values(spark, [("gone/x.ts",), ("src/m0/doc_0.ts",)], "path string"))
    listed = listed.select("path", F.when(F.col("path") == "gone/x.ts", "deleted").otherwise("modified").alias("kind"), F.lit(False).alias("binary"))
    return changes.changed_file_flags(listed, hunks, over, files)


# --- policy -----------------------------------------------------------------------

POLICY = {"layers": [{"name": "low", "include": ["src/m[0-4]/**"]}, {"name": "mid", "include": ["src/m[5-9]/**"]}, {"name": "tens", "include": ["src/m1[0-5]/*"]}], "rules": [{"from": "low", "deny": ["mid", "tens"]}, {"from": "tens", "deny": ["low"]}]}
_LAYERS = "layers AS (SELECT path, CASE WHEN regexp_matches(path, '^src/m[0-4]/') THEN 'low' WHEN regexp_matches(path, '^src/m[5-9]/') THEN 'mid' WHEN regexp_matches(path, '^src/m1[0-5]/[^/]*$') THEN 'tens' END AS layer FROM files)"
_VIOLATIONS = f"WITH {EDGES}, {_LAYERS}, bad AS (SELECT a.layer AS from_layer, b.layer AS to_layer, source_path, target_path, line, raw_target FROM edges JOIN layers a ON a.path = source_path JOIN layers b ON b.path = target_path WHERE resolution = 'exact' AND ((a.layer = 'low' AND b.layer IN ('mid', 'tens')) OR (a.layer = 'tens' AND b.layer = 'low')))"


@query("layer_classify", f"WITH {FILES}, {_LAYERS} SELECT path, layer FROM layers")
def _layers(spark, sf):
    return policy.classify(code_files(spark, sf).select("path"), policy.compile_policy(POLICY))


@query("boundary_violations", f"{_VIOLATIONS} SELECT * FROM bad")
def _violations(spark, sf):
    return policy.evaluate(code_files(spark, sf), script_edges(spark, sf), policy.compile_policy(POLICY))[1].drop("kind", "resolver")


@query("boundary_counts", f"{_VIOLATIONS} SELECT (SELECT count(*) FROM files) AS checked_files, (SELECT count(*) FROM layers WHERE layer IS NULL) AS unclassified_files, (SELECT count(*) FROM edges WHERE resolution = 'exact') AS exact_edges, (SELECT count(*) FROM edges WHERE resolution <> 'exact') AS unresolved_observations, (SELECT count(*) FROM bad) AS violations")
def _counts(spark, sf):
    return policy.evaluate(code_files(spark, sf), script_edges(spark, sf), policy.compile_policy(POLICY))[0]


_SCOPE = ["src/m3/doc_3.ts", "src/m1/../m0/doc_60.ts", "src/m13/doc_13.js"]
_SCOPED = "('src/m3/doc_3.ts', 'src/m0/doc_60.ts', 'src/m13/doc_13.js')"


@query("boundary_scoped", f"{_VIOLATIONS} SELECT (SELECT count(*) FROM files WHERE path IN {_SCOPED}) AS checked_files, (SELECT count(*) FROM layers WHERE layer IS NULL AND path IN {_SCOPED}) AS unclassified_files, (SELECT count(*) FROM edges WHERE resolution = 'exact' AND source_path IN {_SCOPED}) AS exact_edges, (SELECT count(*) FROM edges WHERE resolution <> 'exact' AND source_path IN {_SCOPED}) AS unresolved_observations, (SELECT count(*) FROM bad WHERE source_path IN {_SCOPED}) AS violations")
def _scoped(spark, sf):
    return policy.evaluate(code_files(spark, sf), script_edges(spark, sf), policy.compile_policy(POLICY), _SCOPE)[0]


# --- status, refresh, metrics -----------------------------------------------------


@query("index_status", f"WITH {EDGES}, {SYMBOLS[len(LINES) + 2 :]} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM imports) AS imports, count(*) FILTER (WHERE resolution = 'exact') AS exact_edges, count(*) FILTER (WHERE resolution = 'ambiguous') AS ambiguous_edges, count(*) FILTER (WHERE resolution = 'unresolved') AS unresolved_edges FROM edges")
def _status(spark, sf):
    files = code_files(spark, sf)
    found = materialize(line_imports(files), "imports")
    return status.status(files, line_symbols(files), found, resolve.resolve_imports(found, files.select("path", "lang")))


@query("index_fingerprint", f"WITH {FILES} SELECT 'sha256:' || sha256('4' || chr(0) || string_agg(path || chr(0) || sha256(content) || chr(0), '' ORDER BY path)) AS fingerprint FROM files")
def _fingerprint(spark, sf):
    return status.index_fingerprint(code_files(spark, sf))


_NEXT = "SELECT CASE WHEN length(path) % 7 = 0 THEN path || 'x' ELSE path END AS path, CASE WHEN length(content) % 5 = 0 THEN content || '!' ELSE content END AS content FROM files"


@query("index_delta", f"WITH {FILES}, nxt AS ({_NEXT}) SELECT coalesce(f.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN f.path IS NULL THEN 'added' WHEN sha256(f.content) = sha256(n.content) THEN 'touched' ELSE 'changed' END AS change FROM files f FULL JOIN nxt n ON f.path = n.path")
def _delta(spark, sf):
    files = code_files(spark, sf)
    later = over(_NEXT, "files", files).select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))
    return status.detect_changes(files, later)


@query("delta_apply", f"WITH {FILES}, nxt AS ({_NEXT}) SELECT path, sha256(content) AS hash FROM nxt")
def _apply(spark, sf):
    files = code_files(spark, sf).select("path", "hash")
    later = over(_NEXT, "files", code_files(spark, sf)).select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))
    moved = status.detect_changes(files, later)
    upserts = later.join(moved.where("change IN ('added', 'changed')"), "path", "left_semi")
    return status.apply_delta(files, upserts, moved.where("change = 'deleted'").select("path"))


#: Labels of the corpus: every edge, some with a wrong expectation.
_LABELS = "SELECT 'typescript' AS language, source_path, raw_target, line, resolution, CASE WHEN length(source_path) % 5 = 0 AND resolution = 'exact' THEN 'wrong.ts' ELSE target_path END AS expected_target, candidate_paths FROM edges"


@query(
    "graph_quality_metrics",
    f"""WITH {EDGES}, l AS ({_LABELS}), j AS (SELECT e.*, l.resolution AS want, l.expected_target, l.candidate_paths AS wc FROM edges e LEFT JOIN l ON e.source_path = l.source_path AND e.raw_target = l.raw_target AND e.line = l.line),
m AS (SELECT 'typescript' AS language, count(*) FILTER (WHERE want = 'exact') AS labeled_supported, count(*) FILTER (WHERE resolution = 'exact') AS emitted_exact, count(*) FILTER (WHERE want = 'exact' AND resolution = 'exact' AND target_path = expected_target) AS correct_exact, 0::BIGINT AS duplicate_exact, count(*) AS observations, count(*) FILTER (WHERE resolution = 'unresolved') AS unresolved, count(*) FILTER (WHERE want = 'ambiguous') AS labeled_ambiguous, count(*) FILTER (WHERE want = 'ambiguous' AND resolution = 'ambiguous' AND candidate_paths = wc) AS correct_ambiguous FROM j)
SELECT *, emitted_exact - correct_exact AS wrong_exact, round(correct_exact::DOUBLE / nullif(emitted_exact, 0), 6) AS precision, round(correct_exact::DOUBLE / nullif(labeled_supported, 0), 6) AS recall, round(unresolved::DOUBLE / nullif(observations, 0), 6) AS unresolved_rate, round(correct_ambiguous::DOUBLE / nullif(labeled_ambiguous, 0), 6) AS ambiguity_accuracy FROM m""",
)
def _quality(spark, sf):
    edges = script_edges(spark, sf)
    labels = over(_LABELS, "edges", edges)
    return status.graph_quality(labels, edges.withColumn("language", F.lit("typescript")))


@query("largest_source", f"WITH {FILES} SELECT path, strlen(content)::BIGINT AS bytes FROM files ORDER BY bytes DESC, path LIMIT 1")
def _largest(spark, sf):
    return status.largest_source(code_files(spark, sf))


RUNS = [("a", 3.0), ("a", 1.0), ("a", 2.0), ("a", 10.0), ("b", 5.0)]


@query("bench_stats", f"WITH r AS {values_sql(RUNS, 'name, ms')}, s AS (SELECT name, list(ms::DOUBLE ORDER BY ms) AS a FROM r GROUP BY name) SELECT name, a[1] AS min_ms, a[len(a) // 2 + 1] AS median_ms, round(list_sum(a) / len(a), 6) AS mean_ms, a[-1] AS max_ms FROM s")
def _bench(spark, sf):
    return status.timing_stats(values(spark, RUNS, "name string, ms double"))


@query("watch_available_now", f"WITH {FILES} SELECT count(*) AS files, count(DISTINCT path) AS paths FROM files")
def _watch(spark, sf):
    """Changes that arrive as files, applied batch by batch to a table until none is left."""
    from ..streaming.watch import changed_files_stream

    folder = shared_dir(spark, "watch")
    files = code_files(spark, sf).select("path", "hash")
    files.repartition(3).write.parquet(f"{folder}/in")
    seen = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    changed_files_stream(spark, f"{folder}/in", "path string, hash string", seen, f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("files"), F.count_distinct("path").alias("paths"))
