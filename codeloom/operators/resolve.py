"""Imports to file edges in three states: exact, ambiguous, unresolved.

Each observation proposes the paths it could mean; one equi-join with the files
tells which exist. An absolute Python module may sit below any folder, so every
path offers those of its suffixes that are imported instead of being searched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import joined_path, normalized_path, parent_of, stem_of

_SCRIPT_ENDINGS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
RESOLVERS = {"typescript": "typescript-relative-v1", "javascript": "typescript-relative-v1", "python": "python-module-v1", "rust": "rust-local-v1"}


def _ranked(paths: list, rank: int = 0):
    return F.array(*(F.struct(p.alias("path"), F.lit(rank).alias("rank")) for p in paths))


_NONE = "array<struct<path: string, rank: int>>"


def _script(stem):
    plain = ~F.substring_index(stem, "/", -1).rlike(r"^.+\.[^.]*\z")
    more = _ranked([F.concat(stem, F.lit(f".{e}")) for e in _SCRIPT_ENDINGS] + [F.concat(stem, F.lit(f"/index.{e}")) for e in _SCRIPT_ENDINGS])
    return F.when(plain, F.concat(_ranked([stem]), more)).otherwise(_ranked([stem]))


def _python_path(source, raw):
    """The path that a relative module names, or null."""
    dots = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
    module = F.replace(F.regexp_replace(raw, r"^\.+|\.+\z", ""), F.lit("."), F.lit("/"))
    return F.when((dots > 0) & (module != ""), joined_path(parent_of(source), F.concat(F.repeat(F.lit("../"), dots - 1), module)))


def _module_dir(source):
    stem, folder = stem_of(source), parent_of(source)
    return F.when(stem.isin("lib", "main", "mod"), folder).otherwise(joined_path(folder, stem))


def _identity(base):
    own = [F.concat(base, F.lit(".rs")), F.concat(base, F.lit("/mod.rs"))]
    root = [F.concat(base, F.lit("/lib.rs")), F.concat(base, F.lit("/main.rs"))]
    return F.when(F.substring_index(base, "/", -1) == "src", _ranked(own + root)).otherwise(_ranked(own))


def _pairs(stem, rank):
    return F.array(F.struct(F.concat(stem, F.lit(".rs")).alias("path"), rank.alias("rank")), F.struct(F.concat(stem, F.lit("/mod.rs")).alias("path"), rank.alias("rank")))


def _with_proposals(seen: DataFrame) -> DataFrame:
    """Adds __p, the paths an observation could mean, with ranks.

    Rust ranks a path by how many segments it uses; 0 is the fallback. Steps are
    columns of their own, so that no long expression is repeated in another.
    """
    source, raw, rust = F.col("file_path"), F.trim("target"), F.col("lang") == "rust"
    script = F.col("lang").isin("typescript", "javascript") & (F.col("target").startswith("./") | F.col("target").startswith("../"))
    relative = F.when(script, joined_path(parent_of(source), F.col("target"))).when(F.col("lang") == "python", _python_path(source, F.col("target")))
    rows = seen.withColumns({"__rel": relative, "__own": F.when(rust, _module_dir(source)), "__seg": F.when(rust, F.filter(F.split(F.regexp_replace(raw, "^(::)+", ""), "::"), lambda s: s != ""))})
    # how many leading segments are `super`
    others = F.transform("__seg", lambda s: s != "super")
    rows = rows.withColumns({"__stem": normalized_path(F.col("__rel")), "__first": F.get("__seg", F.lit(0)), "__super": F.when(F.array_contains(others, True), F.array_position(others, True) - 1).otherwise(F.size("__seg")).cast("int"), "__parts": F.split("__own", "/")})
    rows = rows.withColumns({"__crate": F.when(F.concat(F.lit("/"), source).contains("/src/"), F.regexp_extract(source, "^(.*/src|src)/", 1)).otherwise(F.lit("")), "__above": F.array_join(F.slice("__parts", 1, F.greatest(F.size("__parts") - F.col("__super"), F.lit(0))), "/"), "__used": F.when(F.col("__first").isin("crate", "self"), 1).otherwise(F.col("__super"))})
    first, none = F.col("__first"), F.array().cast(_NONE)
    rows = rows.withColumns({"__base": F.when(first == "crate", F.col("__crate")).when(first == "super", F.col("__above")).otherwise(F.col("__own")), "__rest": F.slice("__seg", F.col("__used") + 1, F.greatest(F.size("__seg") - F.col("__used"), F.lit(0))), "__fall": F.when(first == "crate", _identity(F.col("__crate"))).when(first == "self", _ranked([source])).when(first == "super", _identity(F.col("__above"))).otherwise(none)})
    rest = F.col("__rest")
    stems = F.transform(F.when(F.size(rest) > 0, F.sequence(F.lit(1), F.size(rest))).otherwise(F.array().cast("array<int>")), lambda n: F.struct(normalized_path(joined_path(F.col("__base"), F.array_join(F.slice(rest, 1, n), "/"))).alias("stem"), n.alias("rank")))
    rows = rows.withColumns({"__stems": stems, "__mod": normalized_path(joined_path(F.col("__own"), raw)), "__fall": F.when((F.size(rest) == 1) & (F.get(rest, F.lit(0)) == "*"), none).otherwise(F.col("__fall"))})
    used = F.concat(F.flatten(F.transform("__stems", lambda x: _pairs(x["stem"], x["rank"]))), F.col("__fall"))
    local = rust & (raw != "") & ~raw.startswith("std::") & ~raw.startswith("core::")
    stem = F.col("__stem")
    proposed = (
        F.when(script, _script(stem))
        .when(F.col("lang") == "python", _ranked([F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py"))]))
        .when(local & (F.col("kind") == "module"), _pairs(F.col("__mod"), F.lit(0)))
        .when(local & (F.size("__seg") > 0), used)
    )
    return rows.select(*seen.columns, proposed.alias("__p"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The edges of all imports (file_path, target, kind, line) of `files` (path, lang).

    Proposals are exploded with nulls kept: the join drops them, and Catalyst
    does not copy the long expressions into filters it infers.
    """
    seen = imports.join(files.select(F.col("path").alias("file_path"), "lang"), "file_path")
    keys, raw, paths = ["file_path", "target", "kind", "line"], F.col("target"), files.select("path")
    direct = _with_proposals(seen).select(*keys, F.explode_outer("__p").alias("p")).select(*keys, F.col("p.path").alias("path"), F.col("p.rank").alias("rank")).join(paths, "path", "left_semi")
    module = F.replace(F.regexp_replace(raw, r"\.+\z", ""), F.lit("."), F.lit("/"))
    absolute = seen.where((F.col("lang") == "python") & ~raw.startswith(".") & (module != "")).select(*keys, F.explode_outer(F.array(F.concat(module, F.lit(".py")), F.concat(module, F.lit("/__init__.py")))).alias("suffix"))
    parts = F.split("path", "/")
    suffixes = paths.where("path LIKE '%.py'").select("path", F.explode_outer(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))
    # only suffixes that some import names; each gathers its paths once, however many imports name it
    named = suffixes.join(absolute.select("suffix").distinct(), "suffix", "left_semi").groupBy("suffix").agg(F.collect_set("path").alias("c"))
    some = direct.groupBy(*keys, "rank").agg(F.collect_set("path").alias("c")).unionByName(absolute.join(named, "suffix").select(*keys, F.lit(0).alias("rank"), "c"))
    # the longest module prefix that exists wins: the candidates of the greatest rank
    best = some.groupBy(*keys, "rank").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("c")).groupBy(*keys).agg(F.max_by("c", "rank").alias("c"))
    resolver = F.create_map(*(F.lit(x) for pair in RESOLVERS.items() for x in pair))
    joined = seen.join(best, keys, "left").withColumn("c", F.coalesce("c", F.array().cast("array<string>")))
    n = F.size("c")
    return joined.select(
        F.col("file_path").alias("source_path"),
        F.col("target").alias("raw_target"),
        F.when(n == 1, F.get("c", F.lit(0))).alias("target_path"),
        "kind",
        "line",
        F.when(n == 1, "exact").when(n == 0, "unresolved").otherwise("ambiguous").alias("resolution"),
        F.coalesce(F.try_element_at(resolver, F.col("lang")), F.lit("unsupported-v1")).alias("resolver"),
        F.when(n > 1, F.col("c")).otherwise(F.array().cast("array<string>")).alias("candidate_paths"),
    )


def neighbours(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """Distinct (path, neighbour) over exact edges: what a file needs, or what needs it."""
    a, b = ("target_path", "source_path") if reverse else ("source_path", "target_path")
    return edges.where("resolution = 'exact'").select(F.col(a).alias("path"), F.col(b).alias("neighbour")).distinct()


def edge_digest(edges: DataFrame) -> DataFrame:
    """One digest of the whole edge set, the same for any order of its rows.

    Rows are hashed one by one and summed by prefix, so that no task or row holds
    all edges at once.
    """
    said = (F.col("source_path"), F.col("raw_target"), F.coalesce("target_path", F.lit("")), F.col("kind"), F.col("line").cast("string"), F.col("resolution"), F.col("resolver"), F.array_join("candidate_paths", "\x01"))
    row = F.sha2(F.concat_ws("\0", *said).cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    total = edges.select(row.alias("h")).agg(F.count("*").alias("n"), *parts)
    return total.select(F.sha2(F.concat_ws("|", "n", *(f"s{i}" for i in range(4))).cast("binary"), 256).alias("digest"))
