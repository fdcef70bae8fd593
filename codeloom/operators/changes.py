"""Diff hunks mapped to the symbols they touch, by overlap of line intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hunk_ranges(headers: DataFrame) -> DataFrame:
    """Adds old_start, old_end, new_start and new_end to rows with `header`
    (`@@ -a,b +c,d @@`); a count of 0 is no range."""
    rows = headers
    for side, mark in (("old", "-"), ("new", r"\+")):
        pattern = r"^@@ .*?" + mark + r"(\d+)(?:,(\d+))?"
        start = F.regexp_extract("header", pattern, 1).cast("int")
        said = F.regexp_extract("header", pattern, 2)
        count = F.when(said == "", 1).otherwise(F.expr("0") + F.when(said == "", "0").otherwise(said).cast("int"))
        rows = rows.withColumn(f"{side}_start", F.when(count > 0, start)).withColumn(f"{side}_end", F.when(count > 0, start + count - 1))
    return rows


def symbol_ranges(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols of all files (files without any keep one row of nulls); invalid ranges become line 1."""
    valid = (F.col("line") > 0) & (F.col("end_line") >= F.col("line"))
    rows = files.select("path").join(symbols.withColumnRenamed("file_path", "path"), "path", "left")
    some = F.col("name").isNotNull()
    return rows.select("path", "name", "kind", F.when(some, F.when(valid, F.col("line")).otherwise(1)).alias("start"), F.when(some, F.when(valid, F.col("end_line")).otherwise(1)).alias("end"), "range_evidence")


def hunk_overlaps(hunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, hunk, name, kind, start, end, range_evidence) of overlapping pairs.

    `hunks` has path, hunk and the four range columns; the new side counts, the
    old one where nothing is new. An equi-join on the path with the overlap as
    its residual condition.
    """
    first, last = F.coalesce("new_start", "old_start"), F.coalesce("new_end", "old_end")
    own = hunks.select("path", "hunk", first.alias("a"), last.alias("b"))
    return own.join(ranges.where("name IS NOT NULL"), "path").where((F.col("a") <= F.col("end")) & (F.col("start") <= F.col("b"))).drop("a", "b")


def narrowest_symbols(overlaps: DataFrame) -> DataFrame:
    """The distinct narrowest symbols of each hunk."""
    width = F.col("end") - F.col("start")
    least = overlaps.groupBy("path", "hunk").agg(F.min(width).alias("w"))
    return overlaps.join(least, ["path", "hunk"]).where(width == F.col("w")).select("path", "name", "kind", "start", "end", "range_evidence").distinct()


def changed_file_flags(changes: DataFrame, hunks: DataFrame, overlaps: DataFrame, files: DataFrame) -> DataFrame:
    """(path, module_level, unindexed, deleted, binary) of each changed file
    (path, kind, binary): module level where a hunk has no symbol or there is none."""
    hit = overlaps.select("path", "hunk").distinct().withColumn("hit", F.lit(True))
    per = hunks.select("path", "hunk").distinct().join(hit, ["path", "hunk"], "left").groupBy("path").agg(F.bool_or(F.col("hit").isNull()).alias("missed"))
    known = files.select("path", F.lit(True).alias("known"))
    rows = changes.join(per, "path", "left").join(known, "path", "left")
    unindexed = F.col("known").isNull()
    return rows.select("path", (unindexed | F.coalesce("missed", F.lit(True))).alias("module_level"), unindexed.alias("unindexed"), (F.col("kind") == "deleted").alias("deleted"), "binary")


def diff_pivots(changes: DataFrame, files: DataFrame, max_files: int) -> DataFrame:
    """Pivots for impact: the first `max_files` changed files that are indexed, in order (ord)."""
    first = changes.orderBy("ord").limit(max_files)
    return first.join(files.select("path"), "path", "left_semi").select("path", "ord", F.lit(0.0).alias("score"))
