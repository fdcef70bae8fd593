"""Keeping indexes fresh with Structured Streaming.

A small stream ticks; each batch is one pass over the watched repositories.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..sources.settings import set_watched, watched
from ..sources.store import refresh_index

LEAST_SECONDS, DEFAULT_SECONDS = 1, 5


class PassFailed(RuntimeError):
    """The first failure of a pass; the other repositories were refreshed."""


def watch_pass(spark: SparkSession, repos: list[str] | None = None, refresh: Callable = refresh_index) -> list[str]:
    """Refresh every watched repository; missing ones leave the list, the first
    failure is raised after all were tried."""
    listed = watched() if repos is None else sorted(set(repos))
    present = [r for r in listed if Path(r).is_dir()]
    if repos is None and present != listed:
        set_watched(present)
    failures = []
    for repo in present:
        try:
            refresh(spark, repo)
        except Exception as e:  # reported once all had their turn
            failures.append((repo, e))
    if failures:
        raise PassFailed(f"{failures[0][0]}: {failures[0][1]}") from failures[0][1]
    return present


def changed_files_stream(spark: SparkSession, folder: str, schema: str, on_batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, seconds: int = DEFAULT_SECONDS):
    """A query over Parquet files of changes that appear in a folder; each file
    goes through `on_batch` exactly once, also after a restart."""
    stream = spark.readStream.schema(schema).parquet(folder)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(on_batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(seconds, LEAST_SECONDS)} seconds")).start()


def watch_loop(spark: SparkSession, checkpoint: str, seconds: int = DEFAULT_SECONDS, repos: list[str] | None = None):
    """A pass every so many seconds until the returned query is stopped."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    run = lambda _batch, _id: watch_pass(spark, repos)
    return ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(processingTime=f"{max(seconds, LEAST_SECONDS)} seconds").start()
