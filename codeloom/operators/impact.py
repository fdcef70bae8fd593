"""Bounded reachability over exact edges, forwards and backwards, with evidence.

A level is one equi-join of the frontier with the edges. The order in which a
breadth-first queue would find a file is kept as an array: the parent's order
and then the edge's. Its smallest value is the first discovery, so no level
needs a global sort, and the cap is one top-k over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_test_path
from ..shared import materialize

ROLES = ("pivot", "dependency", "dependent", "test")
OBSERVATIONS = 50
_STEP = "struct<a: string, b: string, c: string, d: int>"


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def bounded(depth: int = 2, max_files: int = 40, max_tokens: int = 8000) -> tuple[int, int, int]:
    """Depth 1 to 3, files 1 to 500, tokens 64 to 32000."""
    return clamp(depth, 1, 3), clamp(max_files, 1, 500), clamp(max_tokens, 64, 32_000)


def _directed(edges: DataFrame, reverse: bool, with_tests: bool) -> DataFrame:
    a, b = ("target_path", "source_path") if reverse else ("source_path", "target_path")
    first, second = (F.col("source_path"), F.col("target_path")) if reverse else (F.col("target_path"), F.col("source_path"))
    step = F.struct(first.alias("a"), second.alias("b"), F.col("raw_target").alias("c"), F.col("line").alias("d"))
    evidence = F.struct("source_path", "target_path", "line", "raw_target", "kind", "resolver")
    out = edges.where("resolution = 'exact'").select(F.col(a).alias("from"), F.col(b).alias("to"), step.alias("step"), evidence.alias("e"))
    return out if with_tests else out.where(~is_test_path(F.col("to")))


def _levels(pivots: DataFrame, ed: DataFrame, depth: int) -> DataFrame:
    """(path, depth, pos) of every file seen in one direction, pivots at depth 0.

    Each level is written once and read by the next and by the result, so a lost
    executor costs one level; the search ends where a level is empty.
    """
    first = F.array(F.struct(F.lit("").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), F.col("ord").cast("int").alias("d")))
    seen = frontier = pivots.select("path", F.lit(0).alias("depth"), first.alias("pos"))
    for level in range(1, depth + 1):
        reached = frontier.join(ed, frontier.path == F.col("from")).select(F.col("to").alias("path"), F.concat("pos", F.array("step")).alias("pos"))
        fresh = reached.groupBy("path").agg(F.min("pos").alias("pos")).join(seen.select("path"), "path", "left_anti").select("path", F.lit(level).alias("depth"), "pos")
        frontier = materialize(fresh, f"impact-level-{level}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def impact(edges: DataFrame, pivots: DataFrame, directions: set[str], depth: int, max_files: int, include_tests: bool) -> tuple[DataFrame, DataFrame]:
    """Files (path, roles, depth, score, evidence) and omitted paths (path).

    `edges` is read by every level: hand over a table, not a long plan. `pivots`
    has path, ord (their order from 0) and score. Forward goes first; a direction
    takes what the cap leaves.
    """
    depth, max_files, _ = bounded(depth, max_files)
    with_tests = include_tests and "test" in directions
    # at most 500 rows, known to the driver: no plan has to make them again
    held = pivots.select("path", "ord", "score").orderBy("ord").limit(max_files).collect()
    start = edges.sparkSession.createDataFrame([(r.path, int(r.ord), None if r.score is None else float(r.score)) for r in held], "path string, ord int, score double")
    admitted = [r.path for r in held]
    hits, omitted = [], []
    for reverse in (False, True):
        role = "dependent" if reverse else "dependency"
        if not (role in directions or (reverse and "test" in directions)):
            continue
        ed = _directed(edges, reverse, with_tests)
        seen = _levels(start, ed, depth)
        reportable = is_test_path(F.col("path")) | F.lit(role in directions)
        found = seen.where((F.col("depth") > 0) & reportable & ~F.col("path").isin(*admitted))
        own = [r.path for r in found.orderBy("depth", "pos").limit(max_files - len(admitted)).select("path").collect()]
        admitted += own
        omitted.append(found.where(~F.col("path").isin(*own)).select("path") if own else found.select("path"))
        reached = seen.where(F.col("depth") < depth).join(ed, seen.path == F.col("from")).select(F.col("to").alias("path"), (F.col("depth") + 1).alias("depth"), "e").where(reportable)
        hits.append(reached.select("path", "depth", F.when(is_test_path(F.col("path")), F.lit("test")).otherwise(role).alias("role"), "e"))
    whole = edges.select(F.struct("source_path", "target_path", "line", "raw_target", "kind", "resolver").alias("e")).schema["e"].dataType
    rows = start.select("path", F.lit(0).alias("depth"), F.lit("pivot").alias("role"), F.lit(None).cast(whole).alias("e"))
    for h in hits:
        rows = rows.unionByName(h.where(F.col("path").isin(*admitted)))
    rows = rows.join(F.broadcast(start.select("path", "score")), "path", "left")
    role_at = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int")
    roles = F.transform(F.array_sort(F.collect_set(role_at)), lambda i: F.element_at(F.array(*map(F.lit, ROLES)), i))
    result = rows.groupBy("path").agg(roles.alias("roles"), F.min("depth").alias("depth"), F.max("score").alias("score"), _one_a_place(F.array_sort(F.collect_set("e"))).alias("evidence"))
    left_out = omitted[0] if omitted else start.select("path").limit(0)
    for o in omitted[1:]:
        left_out = left_out.unionByName(o)
    return result, left_out.where(~F.col("path").isin(*admitted)).distinct() if admitted else left_out.distinct()


def _one_a_place(evidence):
    """Sorted evidence with one entry for each place, whichever its kind and resolver."""
    place = lambda x: F.struct(*(x[c].alias(c) for c in ("source_path", "target_path", "line", "raw_target")))
    return F.filter(evidence, lambda x, i: (i == 0) | ~place(x).eqNullSafe(place(F.get(evidence, i - 1))))


def in_order(result: DataFrame) -> DataFrame:
    """By first role, depth, score (none last) and path."""
    first = F.array_position(F.array(*map(F.lit, ROLES)), F.get("roles", F.lit(0)))
    return result.orderBy(first, "depth", F.desc_nulls_last("score"), "path")


def observations(edges: DataFrame, pivots: DataFrame) -> DataFrame:
    """What pivots import without an exact target, ambiguous first."""
    rows = edges.where("resolution <> 'exact'").join(pivots.select(F.col("path").alias("source_path")), "source_path", "left_semi")
    return rows.select(F.col("source_path").alias("source"), "raw_target", "kind", "line", "resolver", "resolution", F.col("candidate_paths").alias("candidates")).orderBy("resolution", "source", "line", "raw_target", "kind")
