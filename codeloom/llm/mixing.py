"""Mixing sources to target weights.

One pass sums tokens for each source; repetition rates follow from the targets;
each document is emitted floor(rate) times, plus once more where a hash-seeded
Bernoulli draw with the rate's fraction succeeds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, draw, materialize, n_words, own_columns

#: Up to so many sources the table of rates is broadcast (well under 64 MB);
#: beyond it the rates are joined by a shuffle.
BROADCAST_SOURCES = 200_000
#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    All sizes together are shared by weight. A target stops at `max_repeats`
    times its source; the excess goes to the others by weight until none is
    above. In order of cap over weight the stopped sources come first, so prefix
    sums over the source table find the level of the rest in one pass.
    """
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long")
    caps = total.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_repeats).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("w").over(after)
    found = caps.withColumn("level", level)
    found = found.withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(whole))
    target = F.least(F.col("w") * F.coalesce("level", F.lit(0.0)), F.col("cap").cast("double"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return found.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


MADE = ("size", "source_size", "target", "copies")


def _mixed(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[int, ...], max_repeats: int, seed: int, broadcast_sources: int) -> DataFrame:
    """`row`, a struct of all columns of `docs`, beside the columns that are MADE,
    so that no name of one can hide the other."""
    sized = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("id"), docs[source_col].alias("source"), n_words(docs[text_col].cast("string")).alias("size"))
    plan = materialize(source_targets(sized.select("source", "size"), weights, max_repeats), "mix-sources").withColumnRenamed("source", "of")
    if plan.count() <= broadcast_sources:
        plan = F.broadcast(plan)
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("of")), "left")
    whole = F.floor("rate")
    extra = F.when(draw(F.col("id"), seed) < F.col("rate") - whole, 1).otherwise(0)
    return joined.withColumn("copies", (whole + extra).cast("int")).select("row", *MADE)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 7, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """All rows of `docs` with size, source_size, target and copies.

    `copies` is how often the mix takes a document; `mixed_rows` gives the rows so
    often. A null text has size 0 and so has an empty one; a text of any length
    is counted whole, in one pass over it. A null source is a source of its own
    (the last), a null identifier draws like the empty string, and rows that
    repeat an identifier share its draw. Sources of size 0 get the target 0; ties
    in the order of sources go by code point. An empty table gives no row.
    Columns of `docs` that bear a name of the result are replaced; all others
    stay, whatever their names.
    """
    mixed = _mixed(docs, id_col, source_col, text_col, weights, max_repeats, seed, broadcast_sources)
    return mixed.select(*(F.col("row")[c].alias(c) for c in own_columns(docs, *MADE)), *MADE)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 7, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The rows of `docs`, all their columns as they are, each as often as the mix
    takes it (see `mix_sources`); rows of no copies go."""
    mixed = _mixed(docs, id_col, source_col, text_col, weights, max_repeats, seed, broadcast_sources).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM t),
l AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio,
        CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
s AS (SELECT source, source_size, cap, w, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1), 0) AS level FROM l),
p AS (SELECT source, source_size, least(w * level, CAST(cap AS DOUBLE)) AS target FROM s),
j AS (SELECT d.doc_id, d.size, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0.0 END AS rate,
        CAST(CAST('0x' || substr(md5('7|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j
"""
