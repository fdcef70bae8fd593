"""Counts, fingerprints, refresh deltas, graph-quality metrics and timing statistics."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SCHEMA_VERSION

#: Beyond so many changed files or bytes a refresh rebuilds the whole index.
REBUILD_FILES, REBUILD_BYTES = 256, 64 << 20


def status(files: DataFrame, symbols: DataFrame, imports: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts."""
    rows = [t.agg(F.count("*").alias(n)) for t, n in ((files, "files"), (symbols, "symbols"), (imports, "imports"))]
    by = edges.agg(*(F.count_if(F.col("resolution") == s).alias(f"{s}_edges") for s in ("exact", "ambiguous", "unresolved")))
    out = rows[0]
    for r in (*rows[1:], by):
        out = out.join(r, F.lit(True))
    return out


def _digest(batches):
    whole = hashlib.sha256(f"{SCHEMA_VERSION}\0".encode())
    for batch in batches:
        for path, mark in zip(*(c.to_pylist() for c in batch.columns)):
            whole.update(f"{path}\0{mark}\0".encode())
    yield pa.record_batch([pa.array([f"sha256:{whole.hexdigest()}"])], ["fingerprint"])


def index_fingerprint(files: DataFrame) -> DataFrame:
    """`sha256:` and the hash of the schema version and every path and hash in
    order of path, each ended by a NUL.

    A hash of one sequence has to see it in order: the sorted pairs stream
    through one task that holds a batch at a time, whatever their number.
    """
    pairs = files.select("path", "hash").repartition(1).sortWithinPartitions("path", "hash")
    return pairs.mapInArrow(_digest, "fingerprint string")


def repo_fingerprint(root: str) -> str:
    return hashlib.sha256(root.encode()).hexdigest()


def detect_changes(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) against the index: added, changed, deleted or touched.

    Both sides have path and hash; `current` may have `newer` (modified since the
    index was made), without which every known file is compared.
    """
    now = current if "newer" in current.columns else current.withColumn("newer", F.lit(True))
    rows = indexed.select("path", F.col("hash").alias("old")).join(now.select("path", F.col("hash").alias("new"), "newer"), "path", "full_outer")
    change = F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull(), "added").when(F.col("newer"), F.when(F.col("old") == F.col("new"), "touched").otherwise("changed"))
    return rows.select("path", change.alias("change")).where("change IS NOT NULL")


def apply_delta(table: DataFrame, upserts: DataFrame, deleted: DataFrame, key: str = "path") -> DataFrame:
    """`table` without the rows of changed and deleted files, with the new ones."""
    gone = upserts.select(key).unionByName(deleted.select(F.col("path").alias(key))).distinct()
    return table.join(gone, key, "left_anti").select(*table.columns).unionByName(upserts.select(*table.columns))


def needs_rebuild(n_changes: int, n_bytes: int) -> bool:
    return n_changes > REBUILD_FILES or n_bytes > REBUILD_BYTES


def graph_quality(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Metrics of each language.

    `labels` has language, source_path, raw_target, line, resolution,
    expected_target and candidate_paths; `edges` the columns of an edge and
    language. Both meet on language, source, target as written and line. An
    exact label is credited once however often it is emitted; what is emitted
    exact without credit is wrong. Ratios without a denominator are null.
    """
    key = ["language", "source_path", "raw_target", "line"]
    whole = F.xxhash64("target_path", "kind", "resolver", F.col("candidate_paths").cast("string"))
    of = lambda s: F.col("resolution") == s
    want = labels.groupBy(*key).agg(
        F.max_by(F.when(of("exact"), F.col("expected_target")), of("exact").cast("int")).alias("target"),
        F.bool_or(of("exact")).alias("label_exact"),
        F.count_if(of("ambiguous")).alias("label_ambiguous"),
        F.collect_list(F.when(of("ambiguous"), F.col("candidate_paths"))).alias("want_paths"),
    )
    got = edges.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.count_if(of("exact")).alias("n_exact"),
        F.count_distinct(F.when(of("exact"), whole)).alias("kinds"),
        F.collect_set(F.when(of("exact"), F.col("target_path"))).alias("targets"),
        F.count_if(of("unresolved")).alias("n_unresolved"),
        F.collect_set(F.when(of("ambiguous"), F.col("candidate_paths"))).alias("paths"),
    )
    zero = F.lit(0)
    ok = F.coalesce((F.col("label_exact") & F.array_contains("targets", F.col("target"))).cast("long"), zero)
    met = F.size(F.filter("want_paths", lambda w: F.coalesce(F.array_contains("paths", w), F.lit(False))))
    sums = want.join(got, key, "full_outer").groupBy("language").agg(
        F.sum(F.coalesce(F.col("label_exact").cast("long"), zero)).alias("labeled_supported"),
        F.sum(F.coalesce("n_exact", zero)).alias("emitted_exact"),
        F.sum(ok).alias("correct_exact"),
        F.sum(F.coalesce(F.col("n_exact") - F.col("kinds"), zero)).alias("duplicate_exact"),
        F.sum(F.coalesce("n", zero)).alias("observations"),
        F.sum(F.coalesce("n_unresolved", zero)).alias("unresolved"),
        F.sum(F.coalesce("label_ambiguous", zero)).alias("labeled_ambiguous"),
        F.sum(F.when(F.col("want_paths").isNotNull(), met).otherwise(0)).cast("long").alias("correct_ambiguous"),
    )
    ratio = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    return sums.select(
        "*",
        (F.col("emitted_exact") - F.col("correct_exact")).alias("wrong_exact"),
        ratio("correct_exact", "emitted_exact").alias("precision"),
        ratio("correct_exact", "labeled_supported").alias("recall"),
        ratio("unresolved", "observations").alias("unresolved_rate"),
        ratio("correct_ambiguous", "labeled_ambiguous").alias("ambiguity_accuracy"),
    )


def timing_stats(runs: DataFrame) -> DataFrame:
    """(name, min_ms, median_ms, mean_ms, max_ms) of rows (name, ms); the median is the element at n / 2."""
    rows = runs.groupBy("name").agg(F.array_sort(F.collect_list("ms")).alias("a"))
    mean = F.aggregate("a", F.lit(0.0), lambda s, x: s + x) / F.size("a")
    return rows.select("name", F.element_at("a", 1).alias("min_ms"), F.get("a", (F.size("a") / 2).cast("int")).alias("median_ms"), F.round(mean, 6).alias("mean_ms"), F.element_at("a", -1).alias("max_ms"))


def largest_source(files: DataFrame) -> DataFrame:
    """The largest source file; of equals the first by path."""
    size = F.octet_length("content").cast("long")
    endings = F.col("path").rlike(r"\.(rs|ts|tsx|js|jsx|py)\z")
    return files.where(endings).select("path", size.alias("bytes")).orderBy(F.desc("bytes"), "path").limit(1)
