"""From raw documents to packed token sequences.

Five stages, each over all rows that the one before kept: quality classifier
(rejected documents go), exact dedup, near-duplicate join (the smallest
identifier of each component stays), mixing of sources to target weights, and
packing. The last stage returns boundary records, the others the columns of
documents, whatever else these are called. Texts are read whole, however long;
an empty table passes every stage as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.common import bound_batches, documents
from codeloom.llm.exact_dedup import distinct_rows
from codeloom.llm.jaccard_join import near_distinct_rows
from codeloom.llm.mixing import mixed_rows
from codeloom.llm.packing import pack
from codeloom.llm.quality_classifier import accepted_rows, train

#: A trained classifier and a tokenizer have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


#: Fewer than op9_pack remembers: here the workers already hold what earlier stages left.
MEMO_PIECES = 400_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts 1. A null text is judged as
    the empty one, repeated rows alike; a null identifier stays as it is."""
    bound_batches(spark)
    return accepted_rows(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null equals empty) one row, with the smallest identifier,
    a null one only where there is no other; of rows that tie, any one."""
    bound_batches(spark)
    return distinct_rows(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the row with the smallest identifier, nulls last;
    texts without words stay."""
    bound_batches(spark)
    return near_distinct_rows(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for; a null source is
    one of its own, texts without words go or stay by the same rate."""
    bound_batches(spark)
    return mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the documents in sequences of 1024 ids; a null text
    gives the end id alone, repeated rows are packed each."""
    import public_tokenizers

    bound_batches(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, memo_pieces=MEMO_PIECES)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram jaccard join", near_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
