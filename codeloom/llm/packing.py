"""Packing by concatenate and cut.

Pass one tokenises every document where it lies and notes its place among the
ids of its partition; a prefix sum over the partitions' totals makes the places
global. Pass two cuts the ids at multiples of the window and leaves a boundary
record for each piece. Texts are never shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shared_dir
from .tokens import encoder, slices

WINDOW = 1024
#: Up to so many partitions their bases are broadcast (16 bytes each); beyond it
#: they are joined by a shuffle.
BROADCAST_PARTS = 1_000_000
ENCODED = "part int, first long, n long, doc_id long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tokenise(tokenizer: str, end_id: int, memo_pieces: int | None):
    def run(batches):
        coder, part, first = encoder(tokenizer, memo_pieces), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=coder.dtype).tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = [x or 0 for x in pc.binary_length(texts).to_pylist()]
            for a, b in slices(sizes):
                raw = [np.frombuffer(x, "<u4").astype(coder.dtype).tobytes() + end for x in coder.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])]
                n = np.array([len(x) // coder.dtype.itemsize for x in raw], dtype=np.int64)
                firsts = first + np.cumsum(n) - n
                first += int(n.sum())
                yield pa.record_batch([pa.array([part] * (b - a), pa.int32()), pa.array(firsts), pa.array(n), ids.slice(a, b - a), pa.array(raw, pa.binary())], ["part", "first", "n", "doc_id", "ids"])

    return run


def _cut(window: int):
    def run(batches):
        for batch in batches:
            at, ns, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            which, start, length, crc, whole, seq, off = ([] for _ in range(7))
            for i, (g, n) in enumerate(zip(at.tolist(), ns.tolist())):
                raw = np.frombuffer(batch.column(3)[i].as_buffer(), dtype=f"<u{len(batch.column(3)[i].as_buffer()) // n}").astype("<u4").tobytes()
                s = 0
                while s < n:
                    take = min(n - s, window - (g + s) % window)
                    which.append(i)
                    start.append(s)
                    length.append(take)
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + take)]))
                    whole.append(n)
                    seq.append((g + s) // window)
                    off.append((g + s) % window)
                    s += take
            yield pa.record_batch([docs.take(pa.array(which, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, whole, seq, off))], [x.split()[0] for x in PIECES.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", broadcast_parts: int = BROADCAST_PARTS, memo_pieces: int | None = None) -> DataFrame:
    """One boundary record for each piece of a document in a sequence.

    Sequences hold `window` ids; all are full but the last, which the loader
    pads. A null text is empty and gives the end id alone; rows that repeat an
    identifier are packed each; a null identifier stays null; a long text is cut
    at every window; an empty table gives no piece; other columns are not read,
    whatever their names. A worker remembers `memo_pieces` pieces of texts at most
    (None: MEMO_PIECES of tokens.py).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    path = shared_dir(spark, "packed-ids")
    rows.mapInArrow(_tokenise(tokenizer, end_id, memo_pieces), ENCODED).write.option("compression", "zstd").parquet(path)
    encoded = spark.read.schema(ENCODED).parquet(path)
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    bases = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    if encoded.select("part").distinct().count() <= broadcast_parts:
        bases = F.broadcast(bases)
    placed = encoded.join(bases, "part").select((F.col("base") + F.col("first")).alias("at"), "n", "doc_id", "ids")
    return placed.mapInArrow(_cut(window), PIECES)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
