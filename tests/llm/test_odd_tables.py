"""Null and repeated identifiers, empty tables, long texts and columns whose names
clash, for every operator and stage."""

import corpus_pipeline
import public_tokenizers
import pytest

from codeloom.llm import language_id, quality_classifier
from codeloom.llm.exact_dedup import distinct_rows, exact_dedup
from codeloom.llm.jaccard_join import jaccard_components, near_distinct_rows
from codeloom.llm.mixing import mix_sources, mixed_rows
from codeloom.llm.quality_rules import ngram_weights, quality_rules
from codeloom.llm.secrets import scan_secrets

#: Names that operators use for results and for steps on the way.
CLASHING = ["rate", "source_size", "target", "copies", "row", "id", "key", "size", "kept", "keep_id", "group_size", "score", "predicted", "text_", "part", "at", "of", "n", "words", "spans", "sha", "n_bytes", "ties", "component_id", "key_bits", "gone_id", "__text", "__score", "__n", "__sha", "__source", "__g", "h", "lines", "ok", "llr", "u", "bound", "x", "gram", "node", "pair"]
PROSE = "the quick brown fox jumps over the lazy dog and runs into the green forest where it sleeps until morning comes"
ROWS = [(1, PROSE, "en", "b"), (1, PROSE, "en", "b"), (2, PROSE + "  ", "en", None), (None, PROSE + " again", "en", "a"), (None, PROSE + " again", "en", "a"), (3, None, None, None), (4, "", "en", "a"), (4, "Ⅷ ½ ²", "en", "a"), (5, "w " * 120000, "en", "c"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    names = ["doc_id", "text", "lang", "source", *CLASHING]
    types = ["long", "string", "string", "string"] + ["string"] * len(CLASHING)
    rows = [(*r, *(f"{c}{i}" for c in CLASHING)) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in zip(names, types))).repartition(3)


def whole(df, columns):
    return sorted((tuple(r) for r in df.select(*(df[c] for c in columns)).collect()), key=str)


def test_mixing(docs):
    made = ["size", "source_size", "target", "copies"]
    own = [c for c in docs.columns if c not in made]
    out = mix_sources(docs)
    assert whole(out, own) == whole(docs, own)
    sizes = {r.doc_id: r["size"] for r in out.collect()}
    assert sizes[5] == 120000 and sizes[3] == 0
    repeated = mixed_rows(docs)
    assert repeated.columns == docs.columns and set(whole(repeated, docs.columns)) <= set(whole(docs, docs.columns))
    assert repeated.count() == sum(r.copies for r in out.collect())
    assert mixed_rows(docs.limit(0)).count() == 0


def test_language(docs):
    assert [language_id.has_letter(t) for t in ("", "Ⅷ ½ ² ①", "1_2", "_é", "日", "ª", "\u02b0", "\u0301", "5a")] == [False, False, False, True, True, True, True, False, True]
    got = language_id.identify(docs, language_id.train(docs))
    assert got.count() == len(ROWS)
    assert {r.doc_id for r in got.where("lang_pred = 'und'").collect()} == {None, 3, 4}
    assert len(set(map(tuple, got.where("doc_id = 1").collect()))) == 1
    assert language_id.identify(docs.limit(0), {"families": {}, "family": {}, "pair": {}}).count() == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (5, 0), (None, 0)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    out = quality_classifier.score_quality(docs, model)
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    assert whole(out, own) == whole(docs, own) and all(0 <= r.score <= 1 for r in out.collect())
    kept = quality_classifier.accepted_rows(docs, model)
    assert kept.columns == docs.columns and kept.count() == out.where("predicted = 1").count()
    assert quality_classifier.score_quality(docs.limit(0), model).count() == 0


def test_rules_and_secrets(spark, docs):
    rules = quality_rules(docs, ngram_weights(docs, spark.createDataFrame([(1,), (1,), (None,)], "doc_id long"), 64))
    assert rules.count() == len(ROWS)
    assert {r.n_words for r in rules.where("doc_id = 5").collect()} == {120000}
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = scan_secrets(docs, path)
    assert found.count() == len(ROWS) and {r.spans for r in found.collect()} == {""}
    odd = spark.createDataFrame([(None, "AKIA" + "Q" * 16, "x")] * 2, "doc_id long, text string, spans string")
    assert [(r.doc_id, r.n_access, r.spans) for r in scan_secrets(odd, path).collect()] == [(None, 1, "access:0:20")] * 2
    assert scan_secrets(odd.limit(0), path).count() == 0


def test_exact(docs):
    made = ("keep_id", "group_size", "kept", "text_sha256")
    own = [c for c in docs.columns if c not in made]
    out = exact_dedup(docs)
    assert whole(out, own) == whole(docs, own)
    kept = distinct_rows(docs)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count() == 6
    one = docs.where("doc_id = 1 AND `at` = 'at0' OR doc_id > 1").where("doc_id <> 4 OR text = ''")
    assert sorted(r.doc_id for r in distinct_rows(one).collect()) == [1, 2, 3, 5]  # identifiers are unique here
    assert distinct_rows(docs.limit(0)).count() == 0


def test_near(docs):
    out = jaccard_components(docs)
    assert out.count() == len(ROWS)
    assert {(r.doc_id, r.component_id) for r in out.where("doc_id <= 2").collect()} == {(1, 1), (2, 1)}
    kept = near_distinct_rows(docs)
    assert kept.columns == docs.columns
    # the two rows of 1 agree in identifier and text, so both stay; whatever links with them goes
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 1, 3, 4, 4, 5]


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out, empty = stage(spark, docs, str(tmp_path)), stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and out.count() >= 0
        if name != "packing":
            assert out.columns == docs.columns
            assert set(whole(out, docs.columns)) <= set(whole(docs, docs.columns))
