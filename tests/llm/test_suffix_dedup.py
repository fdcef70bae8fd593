"""op3 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from codeloom.llm.suffix_dedup import anchors, prefix_intervals, remove_repeats


def brute(texts, length):
    """What each text keeps and how much goes, from all strings of `length` bytes."""
    raws = [(t or "").encode() for t in texts]
    starts = {}
    for d, raw in enumerate(raws):
        for i in range(len(raw) - length + 1):
            starts.setdefault(raw[i : i + length], []).append((d, i))
    gone = [np.zeros(len(r), bool) for r in raws]
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = True
    out = {}
    for d, raw in enumerate(raws):
        g = gone[d]
        runs = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        out[d] = (len(raw), int(g.sum()), runs, hashlib.sha256(bytes(b for b, x in zip(raw, g) if not x)).hexdigest())
    return out


def texts_of(seed, length):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, exact, other = prose(60)[: length + 40], prose(50)[:length], prose(90)
    texts = [None, "", "short", prose(200), prose(200)]
    texts += [prose(30) + passage + prose(30) for _ in range(7)]
    texts += [prose(5) + exact + prose(rnd.randint(0, 9)) for _ in range(3)] + [exact, exact[:-1] + "#"]
    texts += [other, other, other + "x", "y" + other, other[:100] + "Q" + other[101:]]
    texts += ["ab" * 300, "z" * 700, prose(40) + other[10:] + prose(4) + other[:-30]]
    for _ in range(6):
        copy = list(other)
        for _ in range(2):
            copy[rnd.randrange(len(copy))] = "#"
        texts.append("".join(copy))
    return texts


@pytest.mark.parametrize(("seed", "length", "gram", "block"), [(1, 120, 20, 1000), (2, 150, 30, 3), (3, 64, 16, 2)])
def test_against_brute_force(spark, seed, length, gram, block):
    texts = texts_of(seed, length)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = remove_repeats(docs, length, gram, block).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute(texts, length)


def test_production_length(spark):
    base = " ".join(str(i * i) for i in range(400))
    texts = [base, "a" + base[:399], "b" + base[5:405] + "c", base[900:1299], "long " * 20000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs).collect()}
    assert got == brute(texts, 400)
    assert remove_repeats(docs.limit(0)).count() == 0


def shared_words(rows, passage):
    """Words in passages of at least `passage` words that another (doc_id, text) holds too."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    homes = {}
    for row, words in zip(rows, split):
        for i in range(len(words) - passage + 1):
            homes.setdefault(tuple(words[i : i + passage]), set()).add(row)
    out = []
    for words in split:
        held = set()
        for i in range(len(words) - passage + 1):
            if len(homes[tuple(words[i : i + passage])]) > 1:
                held.update(range(i, i + passage))
        out.append(len(held))
    return out


@pytest.mark.parametrize(("seed", "passage", "gram", "block"), [(5, 20, 4, 1000), (6, 12, 3, 3)])
def test_shared_words(spark, seed, passage, gram, block):
    texts = texts_of(seed, 120)
    rnd = random.Random(seed)
    tail = " ".join(str(rnd.randrange(99)) for _ in range(passage + 3))
    texts += [f"{rnd.random()} {tail}" for _ in range(4)] + [tail + "\n\t" + tail, "la " * 90, "la " * 70]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_shared_words for r in remove_repeats(docs, block=block, passage=passage, word_gram=gram).collect()}
    assert [got[i] for i, _ in rows] == shared_words(rows, passage)


def test_rows_without_or_with_one_identifier(spark):
    a, q = (random.Random(k).randbytes(700).hex()[:900] for k in (1, 2))
    rows = [(3, a, 1), (3, q, 2), (4, q, 3), (None, q[:700] + "....x", 4), (None, None, 5), (None, "", 6), (None, a[:300], 7), (8, a[100:450], 8), (None, q, 9), (None, q, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long").repartition(3)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs).collect())
    want = brute([t for _, t, _ in rows], 400)
    assert got == sorted((d or -1, *want[i]) for i, (d, _, _) in enumerate(rows))


def test_every_window_has_an_anchor():
    raw = np.frombuffer(random.Random(4).randbytes(5000), np.uint8)
    at, _ = anchors(raw, 100, 10)
    assert np.diff(np.concatenate([[-1], at, [len(raw) - 9]])).max() <= 91


def test_prefix_intervals():
    assert sorted(prefix_intervals([2, 3, 1, 1])) == [(1, 0, 4), (2, 0, 2), (3, 1, 2)]
