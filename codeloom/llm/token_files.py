"""Token ids in Arrow files of fixed-size-list batches.

Each file holds equal-length sequences of ids and masks, so that sequence k is
at a known place and can be read without copying; a second file beside it holds
where each document starts. Files follow each other in document order.
"""

from __future__ import annotations

import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, shared_dir
from .tokens import encoder, slices

SEQUENCE = 2048
ROWS = 128  # sequences in a record batch
MANIFEST = "part int, n_docs long, n_tokens long, name string"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _place(url: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(url if urlparse(url).scheme else f"file://{url}")


class SequenceWriter:
    """Cuts a stream of ids into equal-length sequences with masks."""

    def __init__(self, sink, dtype: np.dtype, sequence: int = SEQUENCE):
        self.sequence, self.dtype = sequence, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n += len(ids)
        self.total += len(ids)
        block = self.sequence * ROWS
        if self.n >= block:
            whole = np.concatenate(self.held)
            for k in range(len(whole) // block):
                self._write(whole[k * block : (k + 1) * block], block)
            rest = whole[len(whole) // block * block :]
            self.held, self.n = [rest], len(rest)

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.n:
            ids = np.concatenate(self.held)
            full = -(-len(ids) // self.sequence) * self.sequence
            self._write(np.pad(ids, (0, full - len(ids))), len(ids))
        self.out.close()


class SequenceReader:
    """Random access to the ids of a file, without copying where it is mapped."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.sequence = self.file.schema.field("ids").type.list_size
        self.block = self.sequence * ROWS
        self.at, self.ids, self.mask = -1, None, None

    def _load(self, k: int) -> None:
        if k != self.at:
            batch = self.file.get_batch(k)
            self.at, self.ids = k, batch.column(0).values.to_numpy(zero_copy_only=True)
            self.mask = batch.column(1).values

    def read(self, start: int, n: int):
        """The ids [start, start + n) in pieces of one record batch each."""
        while n > 0:
            k, at = divmod(start, self.block)
            self._load(k)
            take = min(n, self.block - at)
            if self.mask.slice(at, take).true_count != take:
                raise ValueError("a masked place inside a document")
            yield self.ids[at : at + take]
            start, n = start + take, n - take

    def sequence_at(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence k and its mask."""
        batch, row = divmod(k, ROWS)
        self._load(batch)
        a = row * self.sequence
        return self.ids[a : a + self.sequence], np.asarray(self.mask.slice(a, self.sequence))


def _write_part(path: str, tokenizer: str, end_id: int, sequence: int):
    def run(batches):
        fs, folder = _place(path)
        fs.create_dir(folder, recursive=True)
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        ids_sink, docs_sink = (fs.open_output_stream(f"{folder}/{name}.{kind}") for kind in ("arrow", "docs.arrow"))
        writer = SequenceWriter(ids_sink, coder.dtype, sequence)
        docs = pa.ipc.new_file(docs_sink, schema := pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
        n_docs = 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = [x or 0 for x in pa.compute.binary_length(texts).to_pylist()]
            for a, b in slices(sizes):
                starts, counts = [], []
                for raw in coder.encode([t or "" for t in texts.slice(a, b - a).to_pylist()]):
                    own = np.append(np.frombuffer(raw, dtype="<u4"), np.uint32(end_id))
                    starts.append(writer.total)
                    counts.append(len(own))
                    writer.add(own)
                docs.write_batch(pa.record_batch([ids.slice(a, b - a), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=schema))
                n_docs += b - a
        writer.close()
        docs.close()
        ids_sink.close()
        docs_sink.close()
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([writer.total], pa.int64()), pa.array([name])], ["part", "n_docs", "n_tokens", "name"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Write the ids of all documents below `path`; returns the manifest
    (part, n_docs, n_tokens, name, base), base being the ids in the parts before.

    Documents go in ascending order of identifier, nulls first, rows that repeat
    one by a hash of their text. A null text is empty and holds the end id
    alone; a long text runs over as many sequences as it takes. An empty table
    writes files of no sequence. Other columns are not read, whatever their
    names. Each attempt of a task writes files of its own name, and the manifest
    names those of the attempt that Spark committed.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id").asc(), tie).sortWithinPartitions(F.col("doc_id").asc(), tie)
    manifest = materialize(ordered.mapInArrow(_write_part(path, tokenizer, end_id, sequence), MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read_part(path: str):
    def run(batches):
        fs, folder = _place(path)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = SequenceReader(fs, f"{folder}/{name}.arrow")
                index = pa.ipc.open_file(fs.open_input_file(f"{folder}/{name}.docs.arrow"))
                for k in range(index.num_record_batches):
                    docs = index.get_batch(k)
                    starts, counts, sums = docs.column(1).to_numpy(), docs.column(2).to_numpy(), []
                    for s, n in zip(starts.tolist(), counts.tolist()):
                        crc = 0
                        for piece in reader.read(s, n):
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    yield pa.record_batch([docs.column(0), pa.array(starts + base), pa.array(counts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    files = max(1, manifest.count())
    return manifest.repartitionByRange(files, "part").select("name", "base").mapInArrow(_read_part(path), READ)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark, "token-files")
    manifest = write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(manifest, path)
