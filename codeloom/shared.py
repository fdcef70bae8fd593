"""Tables in the folder that all executors share, which cut long lineages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share (spark.checkpoint.dir).

    Where neither that setting nor a checkpoint folder exists, a temporary folder
    becomes the session's checkpoint folder until the process ends, on a local
    master only: executors on other machines would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        held = context._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="codeloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = f"file://{made}"
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder.

    The shuffles behind it are not needed any more; where they are large (`tidy`),
    a collection on the driver lets Spark remove their files.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._codeloom_path = path
    if tidy:
        del df
        spark._jvm.System.gc()
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df._codeloom_path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
