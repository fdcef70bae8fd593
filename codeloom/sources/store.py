"""Snapshots of the index: Parquet tables aside, then one manifest swapped in place.

Readers resolve the manifest once, so a refresh never mixes versions.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rank import postings
from ..operators.resolve import resolve_imports
from ..operators.status import apply_delta, detect_changes, needs_rebuild
from ..operators.syntax import extract_imports, extract_symbols
from ..schemas import SCHEMA_VERSION
from .repository import INDEX_DIR, read_repository

TABLES = ("files", "symbols", "imports", "edges", "terms", "lengths")
VERSION = "1"


class NoIndex(RuntimeError):
    """There is no index, or one of another schema."""


@dataclass
class Index:
    root: str
    indexed_at: str
    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    edges: DataFrame
    terms: DataFrame
    lengths: DataFrame

    def documents(self) -> DataFrame:
        """Files with the text of their symbols, as ranking reads them."""
        names = self.symbols.groupBy(F.col("file_path").alias("path")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "kind", "name", "signature"))), "\n").alias("symbols"))
        return self.files.select("path", "lang", "content").join(names, "path", "left").withColumn("symbols", F.coalesce("symbols", F.lit("")))


def _folder(root: str) -> Path:
    return Path(root) / INDEX_DIR


def manifest(root: str) -> dict:
    try:
        return json.loads((_folder(root) / "manifest.json").read_text())
    except (OSError, ValueError) as e:
        raise NoIndex(f"no index of {root}") from e


def open_index(spark: SparkSession, root: str) -> Index:
    now = manifest(root)
    if now.get("schema_version") != SCHEMA_VERSION:
        raise NoIndex(f"the index of {root} has schema {now.get('schema_version')}")
    at = _folder(root) / now["snapshot"]
    return Index(now["repo_root"], now["indexed_at"], *(spark.read.parquet(str(at / t)) for t in TABLES))


def _write(spark: SparkSession, root: str, files: DataFrame, symbols: DataFrame, imports: DataFrame) -> Index:
    """Write all tables to a new snapshot and point the manifest at it."""
    folder, name = _folder(root), f"snapshot-{uuid.uuid4().hex}"
    at = folder / name
    began = datetime.now(timezone.utc).isoformat()
    for table, rows in (("files", files), ("symbols", symbols), ("imports", imports)):
        rows.write.parquet(str(at / table))
    read = lambda t: spark.read.parquet(str(at / t))
    resolve_imports(read("imports"), read("files").select("path", "lang")).write.parquet(str(at / "edges"))
    held = Index(root, began, read("files"), read("symbols"), read("imports"), read("edges"), None, None)
    terms, lengths = postings(held.documents())
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(str(at / "terms"))
    lengths.write.parquet(str(at / "lengths"))
    made = folder / f".manifest-{uuid.uuid4().hex}"
    made.write_text(json.dumps({"snapshot": name, "repo_root": root, "indexed_at": began, "version": VERSION, "schema_version": SCHEMA_VERSION}))
    os.replace(made, folder / "manifest.json")
    for old in folder.glob("snapshot-*"):
        if old.name != name and old.stat().st_mtime < at.stat().st_mtime - 3600:
            shutil.rmtree(old, ignore_errors=True)  # no reader is that old
    return open_index(spark, root)


def build_index(spark: SparkSession, root: str) -> Index:
    root = str(Path(root).resolve())
    _folder(root).mkdir(parents=True, exist_ok=True)
    files = read_repository(spark, root).drop("mtime")
    return _write(spark, root, files, extract_symbols(files), extract_imports(files))


def refresh_index(spark: SparkSession, root: str) -> Index:
    """Bring an index up to date: build it where there is none of this schema,
    else re-extract what changed; edges are always resolved anew, since a new
    file can change what another file's import means."""
    root = str(Path(root).resolve())
    try:
        index = open_index(spark, root)
    except NoIndex:
        return build_index(spark, root)
    since = datetime.fromisoformat(index.indexed_at).timestamp()
    current = read_repository(spark, root)
    changes = detect_changes(index.files, current.select("path", "hash", (F.col("mtime") > since).alias("newer")))
    # a known file that can't be read now stays as it was
    there = {p for p, _, _ in _listed(root)}
    rows = [r for r in changes.collect() if not (r.change == "deleted" and r.path in there)]
    if not rows:
        return index
    moved = [r.path for r in rows if r.change in ("added", "changed")]
    gone = spark.createDataFrame([(r.path,) for r in rows if r.change == "deleted"], "path string")
    upserts = current.join(F.broadcast(spark.createDataFrame([(p,) for p in moved], "path string")), "path", "left_semi").select("path", "lang", "hash", "content") if len(moved) <= 10_000 else current.select("path", "lang", "hash", "content")
    size = upserts.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
    if needs_rebuild(len(moved) + gone.count(), size):
        return build_index(spark, root)
    files = apply_delta(index.files, upserts, gone)
    moved_rows = upserts.select(F.col("path").alias("file_path")).unionByName(gone.select(F.col("path").alias("file_path")))
    keep = lambda t: t.join(moved_rows, "file_path", "left_anti").select(*t.columns)
    return _write(spark, root, files, keep(index.symbols).unionByName(extract_symbols(upserts)), keep(index.imports).unionByName(extract_imports(upserts)))


def _listed(root: str):
    from .repository import source_paths

    return source_paths(root)


def remove_index(root: str) -> bool:
    folder = _folder(str(Path(root).resolve()))
    if not (folder / "manifest.json").exists():
        return False
    (folder / "manifest.json").unlink()
    for old in folder.glob("snapshot-*"):
        shutil.rmtree(old, ignore_errors=True)
    if not any(folder.iterdir()):
        folder.rmdir()
    return True
