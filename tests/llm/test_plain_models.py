"""op2 and op4 against plain-Python counts, fits and votes on small tables."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from codeloom.llm import language_id, quality_classifier

PARTS = {"en": ["th", "ing", "he", "wh", "ed"], "de": ["sch", "ung", "ei", "ß", "ver"], "fr": ["eau", "é", "que", "oi", "ç"], "es": ["ción", "ñ", "rr", "ll", "os"], "xx": ["zz", "qq"]}


def prose(rnd, parts, n):
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def plain_vector(text):
    raw = b" " + re.sub(r"[\W\d_]+", " ", text).lower().encode() + b" "
    n = language_id.DIMENSIONS - 256
    counts = [0] * language_id.DIMENSIONS
    place = lambda gram: 256 + ((int.from_bytes(gram, "big") * 2654435761 & 0xFFFFFFFF) >> 8) % n
    ended = raw + bytes(2)  # grams reach over the end of a text
    for i in range(len(raw)):
        counts[raw[i]] += 1
        for k in (2, 3):
            counts[place(ended[i : i + k])] += 1
    roots = [math.sqrt(c) for c in counts]
    norm = math.sqrt(sum(x * x for x in roots))
    return [x / norm for x in roots]


def plain_svm(rows, signs, cost=10.0, steps=150):
    """Squared hinge loss, each side of weight one half, by accelerated gradients."""
    sides = {s: sum(1 for y in signs if (y > 0) == s) for s in (True, False)}
    weight = [0.5 / sides[y > 0] * cost for y in signs]
    rows = [[*x, 1.0] for x in rows]
    w = [0.0] * len(rows[0])
    v = list(w)
    rate = 1 / (1e-2 + 4 * sum(weight))
    for k in range(steps):
        slope = [1e-2 * a for a in v]
        for x, y, c in zip(rows, signs, weight):
            gap = 1 - y * sum(a * b for a, b in zip(x, v) if a)
            if gap > 0:
                for i, a in enumerate(x):
                    if a:
                        slope[i] -= 2 * c * y * gap * a
        new = [a - rate * b for a, b in zip(v, slope)]
        v = [a + k / (k + 3) * (a - b) for a, b in zip(new, w)]
        w = new
    return w[:-1], w[-1]


def plain_vote(x, model):
    margin = lambda m: sum(a * b for a, b in zip(x, m[0])) + m[1]
    family = max(model["families"], key=lambda f: margin(model["family"][f]))
    codes = model["families"][family]
    wins = {c: 0.0 for c in codes}
    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            m = margin(model["pair"][a, b])
            wins[a if m >= 0 else b] += 1 + 1 / (1 + math.exp(-4 * abs(m))) / len(codes)
    return max(sorted(codes), key=wins.get)


def test_language_by_plain_fit_and_vote(spark):
    rnd = random.Random(8)
    rows = [(i, prose(rnd, PARTS[c], rnd.randint(3, 8)), c, "clash") for i, c in enumerate(rnd.choices(list(PARTS), k=30))]
    rows += rows[:3] + [(None, "que eau", "fr", "x"), (70, "½ Ⅷ", "de", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, u string").repartition(3)
    model = language_id.train(docs)
    taught = sorted((c, plain_vector(t)) for i, t, c, _ in rows if (i is None or zlib.crc32(str(i).encode()) % 4 != 2) and any(map(str.isalpha, t)))
    own = {"en": "germanic", "de": "germanic", "fr": "romance", "es": "romance", "xx": "xx"}
    plain = {"families": {f: sorted({c for c, _ in taught if own[c] == f}) for f in set(own.values())}}
    plain["family"] = {f: plain_svm([x for _, x in taught], [1.0 if own[c] == f else -1.0 for c, _ in taught]) for f in plain["families"]}
    plain["pair"] = {}
    for codes in plain["families"].values():
        for i, a in enumerate(codes):
            for b in codes[i + 1 :]:
                both = [(c, x) for c, x in taught if c in (a, b)]
                plain["pair"][a, b] = plain_svm([x for _, x in both], [1.0 if c == a else -1.0 for c, _ in both])
    assert model["families"] == plain["families"]
    for kind in ("family", "pair"):
        for name, (w, b) in plain[kind].items():
            assert model[kind][name][0] == pytest.approx(w, abs=2e-3) and model[kind][name][1] == pytest.approx(b, abs=2e-3)
    said = lambda i, c: (str(i), c)
    want = [said(i, plain_vote(plain_vector(t), plain) if any(map(str.isalpha, t)) else "und") for i, t, _, _ in rows]
    assert sorted(said(r.doc_id, r.lang_pred) for r in language_id.identify(docs, model).collect()) == sorted(want)


def test_bounded_training_takes_lowest_hashes(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('word ', id) AS text", "if(id % 3 = 0, 'en', if(id = 8, 'fr', 'de')) AS lang")
    seen = []
    real, language_id.fit_svm = language_id.fit_svm, lambda x, y, **_: seen.append(len(y)) or (np.zeros(language_id.DIMENSIONS, np.float32), 0.0)
    try:
        model = language_id.train(docs, max_training=60)
    finally:
        language_id.fit_svm = real
    assert model["families"] == {"germanic": ["de", "en"], "romance": ["fr"]}
    assert sorted(seen) == [40, 41, 41]


def plain_features(text):
    raw, words = text.encode(), text.split()
    kinds = [0] * 8
    for b in raw:
        c = chr(b)
        kinds[7 if b > 127 else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in " \t\n\x0b\x0c\r" else 5 if c in ".,;:?'-" else 6 if 32 < b < 127 else 0] += 1
    n, k = max(1, len(raw)), max(1, len(words))
    share = [x / n for x in kinds]
    lines = [x for x in text.split("\n") if x]
    same = sum(a == b for a, b in zip(words, words[1:])) / k
    return [math.log1p(len(words)), math.sqrt(share[2]), math.sqrt(share[3]), share[4], share[5], math.sqrt(share[6]), share[0], min(1, 4 * share[6]), min(1, 2 * share[2]), len(set(words)) / k, same, math.sqrt(same), 1 - len(set(lines)) / max(1, len(lines)), min(20, n / k) / 20]


def test_quality_by_plain_pairs(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 7)))
    texts = [" ".join(word() for _ in range(rnd.randint(5, 30))) + "." if i % 3 else " ".join(word().upper() + "!!" * rnd.randint(0, 1) for _ in range(rnd.randint(5, 30))) for i in range(60)]
    rows = list(enumerate(texts)) + [(99, None), (None, "a B!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = [(i, int(i % 3 != 0 or i == 12)) for i in range(60)]
    model = quality_classifier.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    taught = [(plain_features(texts[i]), q) for i, q in labels if zlib.crc32(str(i).encode()) % 5]
    columns = list(zip(*(x for x, _ in taught)))
    mean = [sum(c) / len(c) for c in columns]
    spread = [math.sqrt(sum((v - m) ** 2 for v in c) / len(c)) for c, m in zip(columns, mean)]
    spread = [s if s >= 1e-9 else 1.0 for s in spread]
    z = [([(v - m) / s for v, m, s in zip(x, mean, spread)], q) for x, q in taught]
    pairs = [[a - b for a, b in zip(win, loss)] for win, q in z if q for loss, r in z if not r]
    w = list(model["w"])
    slope = [1e-3 * a for a in w]  # the loss over all pairs is flat where the fit ended
    for d in pairs:
        p = 1 / (1 + math.exp(min(30, max(-30, sum(a * b for a, b in zip(d, w))))))
        slope = [g - p * a / len(pairs) for g, a in zip(slope, d)]
    assert max(map(abs, slope)) < 1e-6
    scores = [(sum(a * b for a, b in zip(x, w)), q) for x, q in z]
    errors = lambda t: sum(s < t for s, q in scores if q) / sum(q for _, q in z) + sum(s >= t for s, q in scores if not q) / sum(not q for _, q in z)
    assert errors(model["threshold"]) <= min(errors(s) for s, _ in scores) + 1e-9
    for r in quality_classifier.score_quality(docs, model).collect():
        x = plain_features(r.text or "")
        at = sum((v - m) / s * a for v, m, s, a in zip(x, mean, spread, w)) - model["threshold"] + math.log(0.3 / 0.7)
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, at)))), rel=1e-6)
        assert r.predicted == int(r.score >= 0.3)
