"""Context capsules: ranked files cut to a budget of tokens and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens, lines_of, query_terms

#: What a pointer says of itself.
SOURCE, CONFIDENCE, REASON = "lexical_index", "advisory", "lexical path, source, or symbol match"

# Mode, token budget and file limit by preset.
PRESETS = {
    "default": ("full", 8000, 8),
    "classic": ("full", 8000, 8),
    "files": ("files-only", 1200, 20),
    "files-only": ("files-only", 1200, 20),
    "paths": ("files-only", 1200, 20),
    "tight": ("compact", 2400, 8),
    "small": ("compact", 2400, 8),
    "balanced": ("compact", 8000, 24),
    "agent": ("compact", 8000, 24),
    "full": ("full", 12000, 12),
    "wide": ("files-only", 3000, 40),
    "deep": ("full", 32000, 24),
}
MODES = ("full", "compact", "files-only")


def mode_of(name: str, fallback: str = "full") -> str:
    return name if name in MODES else fallback


def budgeted(sections: DataFrame, max_tokens: int, max_files: int, header_tokens: int) -> DataFrame:
    """Rows (rank, section, ...) of the longest prefix within both limits, with
    estimated_tokens and used. A section has a token at least, so the running
    sum passes the budget once and for all."""
    ahead = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    counted = sections.withColumn("estimated_tokens", estimated_tokens(F.col("section")))
    used = F.sum("estimated_tokens").over(ahead) + header_tokens
    return counted.withColumn("used", used).where((F.col("rank") <= max(max_files, 1)) & (F.col("used") <= max_tokens))


def pointers(kept: DataFrame) -> DataFrame:
    return kept.select("path", "rank", "score", F.lit(SOURCE).alias("source"), F.lit(CONFIDENCE).alias("confidence"), F.lit(REASON).alias("reason"), "estimated_tokens")


def omissions(ranked: DataFrame, kept: DataFrame, max_files: int) -> DataFrame:
    """(reason, count) of what the limits left out; no row for a count of 0."""
    limit = max(max_files, 1)
    n = ranked.agg(F.count("*").alias("n"))
    k = kept.agg(F.count("*").alias("k"))
    both = n.join(k, F.lit(True))
    counts = both.select(F.explode(F.array(F.struct(F.lit("token_budget").alias("reason"), (F.least(F.lit(limit), "n") - F.col("k")).alias("count")), F.struct(F.lit("file_limit").alias("reason"), F.greatest(F.col("n") - limit, F.lit(0)).alias("count")))).alias("o"))
    return counts.select("o.reason", F.col("o.count").cast("long").alias("count")).where("count > 0")


def best_lines(files: DataFrame, query: str, radius: int) -> DataFrame:
    """(path, line, text) around the first line with the most terms of the query."""
    terms = query_terms(query)
    hits = lambda x: sum((F.lower(x).contains(t).cast("int") for t in terms), F.lit(0))
    held = files.select("path", lines_of(F.col("content")).alias("all")).withColumn("score", F.transform("all", hits))
    held = held.withColumn("best", F.array_max("score")).where("best > 0").withColumn("at", F.array_position("score", F.col("best")).cast("int"))
    half = radius // 2
    first = F.greatest(F.col("at") - half, F.lit(1))
    window = held.select("path", first.alias("first"), F.slice("all", first, F.col("at") + half - first + 1).alias("lines"))
    return window.select("path", "first", F.posexplode("lines").alias("k", "text")).select("path", (F.col("first") + F.col("k")).alias("line"), "text")


def excerpts(files: DataFrame, query: str, radius: int) -> DataFrame:
    """(path, excerpt) as numbered lines in a fence."""
    lines = best_lines(files, query, radius).withColumn("said", F.concat(F.lpad(F.col("line").cast("string"), 4, " "), F.lit(": "), "text", F.lit("\n")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "said"))), lambda x: x["said"]), "")
    return lines.groupBy("path").agg(F.concat(F.lit("```text\n"), joined, F.lit("```\n")).alias("excerpt"))


def _limited(items, limit: int):
    return F.array_join(F.when(F.size(items) > limit, F.concat(F.slice(items, 1, limit), F.array(F.lit("...")))).otherwise(items), ", ")


def compact_skeletons(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, skeleton): the first 8 import targets and 24 symbols in two lines."""
    names = symbols.groupBy(F.col("file_path").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "kind", "name"))), lambda s: F.concat(s["kind"], F.lit(" "), s["name"])).alias("s"))
    targets = imports.groupBy(F.col("file_path").alias("path")).agg(F.array_sort(F.collect_set("target")).alias("i"))
    held = files.select("path").join(names, "path", "left").join(targets, "path", "left")
    first = F.when(F.size("i") > 0, F.concat(F.lit("Imports: "), _limited(F.col("i"), 8), F.lit("\n"))).otherwise("")
    second = F.when(F.size("s") > 0, F.concat(F.lit("Symbols: "), _limited(F.col("s"), 24), F.lit("\n"))).otherwise("Symbols: none\n")
    return held.select("path", F.concat(first, second).alias("skeleton"))


def skeletons(files: DataFrame, symbols: DataFrame, imports: DataFrame, detail: str = "standard") -> DataFrame:
    """(path, skeleton) in Markdown, with signatures unless the detail is minimal."""
    said = lambda s: F.concat(F.lit("- `"), s["kind"], F.lit("` "), s["name"], F.lit(" at line "), s["line"].cast("string"), F.lit("\n"), *(() if detail == "minimal" else (F.lit("  `"), s["signature"], F.lit("`\n"))))
    names = symbols.groupBy(F.col("file_path").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "kind", "name", "signature"))), said), "").alias("s"))
    targets = imports.groupBy(F.col("file_path").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("target")), lambda t: F.concat(F.lit("- `"), t, F.lit("`\n"))), "").alias("i"))
    held = files.select("path").join(names, "path", "left").join(targets, "path", "left")
    top = F.when(F.col("i") != "", F.concat(F.lit("## Imports\n\n"), "i", F.lit("\n"))).otherwise("")
    return held.select("path", F.concat(F.lit("# Skeleton: "), "path", F.lit("\n\n"), top, F.lit("## Symbols\n\n"), F.coalesce("s", F.lit("*No symbols detected.*\n"))).alias("skeleton"))


def sections(ranked: DataFrame, files: DataFrame, symbols: DataFrame, imports: DataFrame, query: str, mode: str) -> DataFrame:
    """Ranked rows (path, score) with rank and rendered section; `ranked` is at most a few dozen rows."""
    order = Window.orderBy(F.desc("score"), "path")
    rows = ranked.withColumn("rank", F.row_number().over(order))
    score = F.format_string("%.2f", F.col("score"))
    if mode == "files-only":
        return rows.withColumn("section", F.concat(F.lit("- "), "path", F.lit(" (score: "), score, F.lit(")\n")))
    few = F.broadcast(ranked.select("path"))
    own = files.join(few, "path", "left_semi")
    of = lambda t: t.join(F.broadcast(ranked.select(F.col("path").alias("file_path"))), "file_path", "left_semi")
    bones = skeletons(own, of(symbols), of(imports)) if mode == "full" else compact_skeletons(own, of(symbols), of(imports))
    held = rows.join(bones, "path", "left").join(excerpts(own, query, 12 if mode == "full" else 2), "path", "left")
    return held.withColumn("section", F.concat(F.lit("### "), "path", F.lit(" (score: "), score, F.lit(")\n\n"), F.coalesce("skeleton", F.lit("")), F.lit("\n"), F.coalesce("excerpt", F.lit("")), F.lit("\n"))).drop("skeleton", "excerpt")
