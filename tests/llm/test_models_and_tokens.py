"""op2 and op4 by held-out accuracy; op5 and op9 by exact round trips."""

import random
import time
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from codeloom.llm import language_id, quality_classifier, tokens
from codeloom.llm.common import shared_dir
from codeloom.llm.packing import pack
from codeloom.llm.token_files import SequenceReader, _place, read_token_files, write_token_files
from codeloom.llm.tokens import Encoder

ODD = [None, "", " ", "\n", "a  b", " x", "x \n y", "\n\na", "end\n", "a<|endoftext|>b", "foo  <|endoftext|> z", "İstanbul ΑΣ ς", "a b  c", "é né éx ﬁ", "don't 's'll 12345 ...!!", "tab\tx", "a\x1cb c", "日本語 テスト", "😀 😀x", "a <|startoftext|>", "Word,word. WORD!! w|x | y", "x" * 30000, "the cat " * 9000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    rnd = random.Random(1)
    texts = [t for t in ODD if t is not None] + [" ".join("".join(rnd.choice("aébcÜ.,'1|") for _ in range(rnd.randint(1, 9))) for _ in range(80)) for _ in range(60)]
    path = public_tokenizers.path(name)
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    coder = Encoder(path)
    assert coder.encode(texts) == want and coder.encode(texts) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_is_bounded(name, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 60)
    rnd = random.Random(2)
    texts = [" ".join(["often", "Often,"] + ["".join(rnd.choice("abcde") for _ in range(5)) for _ in range(200)]) for _ in range(6)]
    coder, path = Encoder(public_tokenizers.path(name)), public_tokenizers.path(name)
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for text, ids in zip(texts, want):
        assert coder.encode([text]) == [ids]
        assert len(coder.memo) + len(coder.older) <= 60


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_white_space_at_every_place(name):
    """Whatever the characters and their places, a text that is cut has the library's ids."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(" \n  ab,|<\t\r\x0b\x1c\x85\xa0\u2003\u2028\u3000\ufeff") for _ in range(rnd.randint(1, 7))) for _ in range(6000)]
    texts += [a + "ab" + b + "cd" + c for a in ("", " ", "\n") for b in (" ", "\n", "  ", " \n", "\n ", "\n\n", "<|") for c in ("", " ", "\n")]
    path = public_tokenizers.path(name)
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    coder = Encoder(path)
    assert coder.encode(texts) == want and coder.encode(texts) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_known_pieces_cost_little(name):
    """Encoding texts of known pieces takes a few times as long as cutting and looking them up."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(1000)]
    texts = [" ".join(rnd.choices(words, k=40000)) for _ in range(10)]
    coder, known = Encoder(public_tokenizers.path(name)), dict.fromkeys(words, b"1234")

    def seconds(run):
        best = []
        for _ in range(7):
            began = time.process_time()
            run()
            best.append(time.process_time() - began)
        return min(best)

    coder.encode(texts)
    plain = seconds(lambda: [b"".join(map(known.get, t.replace("\n", " ").split(" "))) for t in texts])
    assert seconds(lambda: coder.encode(texts)) < 3 * plain


def _ids(name, end, texts):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts]


def test_token_files_round_trip(spark):
    docs = spark.createDataFrame([(i * 3, t, "clash") for i, t in enumerate(ODD)], "doc_id long, text string, part string").repartition(4)
    path = shared_dir(spark, "test-files")
    manifest = write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), 1, sequence=64)
    want, start = [], 0
    for i, ids in enumerate(_ids("word_bpe_49k.json", 1, ODD)):
        want.append((i * 3, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, read_token_files(manifest, path).collect())) == want
    fs, folder = _place(path)
    part = max(manifest.collect(), key=lambda r: r.n_tokens)
    reader = SequenceReader(fs, f"{folder}/{part.name}.arrow")
    ids, mask = reader.sequence_at((part.n_tokens - 1) // 64)
    assert len(ids) == 64 and mask.sum() == (part.n_tokens - 1) % 64 + 1 and not ids[~mask].any()
    odd = spark.createDataFrame([(7, "b b"), (None, "z"), (7, "b b"), (7, None), (None, "")], "doc_id long, text string").repartition(2)
    path = shared_dir(spark, "test-files")
    rows = sorted(read_token_files(write_token_files(odd, path, public_tokenizers.path("word_bpe_49k.json"), 1), path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 7, 7, 7] and [r.start for r in rows][1:] == np.cumsum([r.n_tokens for r in rows])[:-1].tolist()
    crcs = [zlib.crc32(i.tobytes()) for i in _ids("word_bpe_49k.json", 1, ["z", "", "b b", "b b", None])]
    assert sorted(r.ids_crc32 for r in rows) == sorted(crcs)
    empty = shared_dir(spark, "test-files")
    assert read_token_files(write_token_files(docs.limit(0), empty, public_tokenizers.path("word_bpe_49k.json"), 1), empty).count() == 0


def test_packing_round_trip(spark):
    texts = ODD + ["again", "again"]
    docs = spark.createDataFrame([(i if i < len(ODD) else 900, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(5)
    none = spark.createDataFrame([(None, "x"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.length) for r in pack(none, public_tokenizers.path("byte_bpe_50k.json"), 0).collect()) == [(None, 1), (None, 2)]
    rows = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, window=50).collect()
    ids = {**dict(enumerate(_ids("byte_bpe_50k.json", 0, ODD))), 900: _ids("byte_bpe_50k.json", 0, ["again"])[0]}
    held: dict[int, list] = {}
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, spans in held.items():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at == 50 or k == max(held)
    assert sum(r.length for r in rows) == sum(map(len, ids.values())) + len(ids[900])
    assert pack(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"), 0).count() == 0


def _prose(rnd, parts, n):
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(n)).capitalize() + "."


def test_language(spark):
    rnd = random.Random(2)
    parts = {"en": ["th", "ing", "he", "wh", "ed"], "de": ["sch", "ung", "ei", "ß", "ver"], "fr": ["eau", "é", "que", "oi", "ç"], "es": ["ción", "ñ", "rr", "ll", "os"]}
    rows = [(i, _prose(rnd, parts[c], rnd.randint(8, 80)), c) for i, c in enumerate(rnd.choices(list(parts), k=400))]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "the thing " * 20000, None), (None, "que eau", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.train(docs)
    assert set(model["families"]) == {"germanic", "romance"} and set(model["pair"]) == {("de", "en"), ("es", "fr")}
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    unseen = [r for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == c for i, _, c in unseen) >= 0.98 * len(unseen)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1002].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    none = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_quality(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    clean = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    junk = (lambda n: " ".join(word() + "***" for _ in range(n)), lambda n: " ".join(word().upper() + "!!" for _ in range(n)), lambda n: " ".join([word()] * n), lambda n: " | ".join(word() for _ in range(n)))
    rows = [(i, junk[i % 4](rnd.randint(20, 90)) if i % 5 == 0 else clean(rnd.randint(20, 90))) for i in range(400)]
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "word " * 40000), (None, clean(30))], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(400)] + [(None, 1), (3, None), (5000, 0)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    out = quality_classifier.score_quality(docs, model).collect()
    got = {r.doc_id: r for r in out}
    unseen = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == int(i % 5 != 0) for i in unseen) >= 0.97 * len(unseen)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out) and len(out) == 404
    assert got[902].predicted == 0 and got[None].predicted == 1
    alone = quality_classifier.train(docs, labels.limit(0))
    assert {r.predicted for r in quality_classifier.score_quality(docs, alone).collect()} == {1}
