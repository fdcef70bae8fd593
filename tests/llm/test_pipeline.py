"""The pipeline's stages against plain Python on a small corpus."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm.common import shared_dir
from codeloom.llm.mixing import mix_sources


def corpus():
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(600)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."
    texts = [prose(rnd.randint(40, 200)) for _ in range(120)]
    texts += [texts[3], texts[3].replace(" ", "  "), texts[5] + " more", "x" + texts[7]]
    texts += [" ".join(w + "***" for w in prose(60).split()) for _ in range(25)]
    return texts


def test_stages(spark, tmp_path):
    texts = corpus()
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 124), 0) for i in range(len(texts)) if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = shared_dir(spark, "stage")
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        seen.append((name, docs))
        if name != "packing":
            assert docs.columns == before.columns
    kept = [sorted(r.doc_id for r in d.select("doc_id").collect()) for _, d in seen[:4]]
    assert kept[0] == list(range(124))
    assert kept[1] == [i for i in range(124) if i not in (120, 121)]
    assert kept[2] == [i for i in kept[1] if i not in (122, 123)]
    copies = {r.doc_id: r.copies for r in mix_sources(seen[2][1]).collect()}
    assert kept[3] == sorted(i for i, n in copies.items() for _ in range(n))
    pieces = seen[4][1].collect()
    fill = {}
    for p in pieces:
        fill.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in fill.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
    assert [sum(n for _, n in fill[k]) for k in sorted(fill)][:-1] == [1024] * (len(fill) - 1)
    from public_tokenizers import path
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = {i: np.array([*library.encode(texts[i], add_special_tokens=False).ids, 0], "<u4") for i in set(kept[3])}
    assert sum(p.length for p in pieces) == sum(len(ids[i]) for i in kept[3])
    assert all(zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces)
    # unwritten stages hand their rows on in another order, which moves the cuts but not what is packed
    held = lambda rows: (sorted({(r.doc_id, r.doc_tokens) for r in rows}), sum(r.length for r in rows), max(r.sequence_id for r in rows))
    assert held(corpus_pipeline.run(spark, str(tmp_path)).collect()) == held(pieces)


def _largest_batch(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    texts = spark.range(0, 4000, 1, 1).select(F.expr("repeat(cast(id % 10 AS string), 5000)").alias("text"))
    return max(r.n for r in texts.mapInArrow(sizes, "n long").collect())


def test_stages_bound_the_batches_of_workers(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    try:
        for _, stage in corpus_pipeline.STAGES[1:]:
            spark.conf.unset(setting)
            stage(spark, docs, "")
            assert _largest_batch(spark) < 5 << 20
        spark.conf.set(setting, str(1 << 20))
        corpus_pipeline.packing_stage(spark, docs, "")
        assert spark.conf.get(setting) == str(1 << 20)
    finally:
        spark.conf.unset(setting)
