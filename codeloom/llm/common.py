"""Shared pieces of the training-data operators: the shared folder, materialised
tables, word patterns and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..shared import release, shared_dir  # noqa: F401 (shared_dir is for the operators)

#: The word and white-space classes of every contract, for Java and Python alike.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
#: Words of 64 bits in a filter of keys: 4 MB, whatever the corpus.
FILTER = 1 << 19
#: Bytes of a batch that is sent to a Python worker, and Spark's setting for it.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder; the shuffles behind it may go."""
    return shared.materialize(df, name, tidy=True)


def bound_batches(spark: SparkSession) -> None:
    """Send Python workers at most BATCH_BYTES (and a row) at once, unless the
    session has a bound of its own: Spark's default, 64 MB, is held several times
    over, in the executor's and the workers' memory beside the heap."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(columns: list[str], *names: str) -> list[str]:
    """Each of `names`, lengthened until no column bears it (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(docs: DataFrame, *replaced: str) -> list[str]:
    """The columns of `docs` but those that a result's columns replace."""
    return [c for c in docs.columns if c.lower() not in replaced]


def _filter_place(*columns: str) -> tuple[str, str]:
    h = f"xxhash64({', '.join(columns)})"
    return f"cast(pmod({h}, {FILTER}) AS int)", f"cast(pmod(shiftrightunsigned({h}, 40), 64) AS int)"


def key_filter(keys: DataFrame, *columns: str) -> DataFrame:
    """One row with a bit map of hashed keys, to be broadcast: a row whose bit is
    not set holds none of them (see `may_hold`) and need not be shuffled to them.
    Its size is `FILTER` words at any scale; where there are more keys than it can
    tell apart, more rows pass, and results stay the same."""
    at, bit = _filter_place(*columns)
    found = keys.select(F.expr(at).alias("at"), F.expr(f"shiftleft(1L, {bit})").alias("b")).groupBy("at").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER, np.int64)
    bits[found.column("at").to_numpy()] = found.column("b").to_numpy()
    row = pa.table({"key_bits": pa.ListArray.from_arrays(pa.array([0, FILTER], pa.int32()), pa.array(bits))})
    return F.broadcast(keys.sparkSession.createDataFrame(row))


def may_hold(*columns: str):
    """The condition of a semi or anti join with a `key_filter`."""
    at, bit = _filter_place(*columns)
    return F.expr(f"getbit(get(key_bits, {at}), {bit}) = 1")


def rows_without(rows: DataFrame, gone: DataFrame, *keys: str, by: tuple[str, ...] = ()) -> DataFrame:
    """`rows` but those whose keys are in `gone` (a plain table; nulls are equal).

    Rows that a filter over the keys (or those in `by`, where the others cost
    much to make) clears are not shuffled.
    """
    by = by or keys
    some = key_filter(gone, *by)
    named = gone.select(*(F.col(k).alias(f"gone_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"gone_{k}"))
    doubtful = rows.join(some, may_hold(*by), "left_semi").join(named, same, "left_anti")
    return rows.join(some, may_hold(*by), "left_anti").unionByName(doubtful)


def n_words(text) -> F.Column:
    """Number of words in a text column (null: 0), without building arrays."""
    once = F.regexp_replace(text, f"{SPACE}*+{WORD}++{SPACE}*+", "x")
    return F.when(text.rlike(WORD), F.length(once)).otherwise(F.lit(0)).cast("long")


def draw(key, seed: int) -> F.Column:
    """A uniform number in [0, 1) from 52 bits of a hash of key and seed."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of `edges`; component is its smallest node.

    Alternates large-star and small-star steps, each one aggregation and one
    equi-join over the edges, until the edge set no longer changes. Every round
    is written to the shared folder, so a lost executor costs one round at most,
    and the one before goes.
    Edges with a null end are ignored; an edge from a node to itself makes the
    node its own component.
    """
    clean = materialize(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL").distinct(), "cc-edges")
    nodes = materialize(clean.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "cc-nodes")
    now = materialize(clean.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-start")
    release(clean)
    seen = None
    for _ in range(max_rounds):
        # large-star: each neighbour above u is tied to the smallest node near u
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, now = now, materialize(small, "cc-round")
        release(before)
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            break
        seen = mark
    else:
        raise RuntimeError("connected components did not converge")
    roots = now.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, nodes.node == roots.u, "left").select("node", F.coalesce("component", "node").alias("component"))
