"""Tables whose rows repeat an identifier or have none."""

import random

import corpus_pipeline
from codeloom.llm.suffix_dedup import remove_repeats


def test_one_of_equal_texts_stays(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(5, "q", "en", "b", 1), (5, "q", "en", "a", 1), (5, "q", "en", "a", 1), (7, "q", "en", "a", 1), (None, "r", "en", "a", 1), (None, "r", "en", "a", 1), (None, "q", "en", "a", 1), (9, "s", "en", "a", 1)]
    out = corpus_pipeline.exact_stage(spark, spark.createDataFrame(rows, schema).repartition(3), "")
    assert sorted((r.doc_id or -1, r.text) for r in out.collect()) == [(-1, "r"), (5, "q"), (9, "s")]


def test_whole_repeated_rows_are_places_of_their_own(spark):
    draw = random.Random(4)
    text, other = ("".join(draw.choices("abcdefghijklmnop ", k=400)) for _ in range(2))
    docs = spark.createDataFrame([(1, text), (1, text), (2, other)], "doc_id long, text string").repartition(2)
    rows = sorted((r.doc_id, r.n_removed) for r in remove_repeats(docs).collect())
    assert rows == [(1, 400), (1, 400), (2, 0)]
