"""op10 against brute force."""

import random
import re

import pytest

from codeloom.llm import jaccard_join
from codeloom.llm.common import connected_components
from codeloom.llm.jaccard_join import jaccard_components, shingles


def brute(texts):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                comp[y] = x
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \n", "one two", "ONE two", "one  two three", "a b c d e", "A B c d e", "İx é É ê ü", "x " * 30000]
    boiler = prose(70)
    for _ in range(25):
        texts.append(" ".join(prose(40) + boiler + prose(40)))
    for size in (12, 60, 150, 400):
        base = prose(size)
        for _ in range(14):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, size // 70))):
                copy[rnd.randrange(size)] = rnd.choice(vocabulary)
            texts.append(" ".join(copy[rnd.randint(0, 3) :]))
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "block"), [(1, 2048), (2, 6)])
def test_against_brute_force(spark, seed, block, monkeypatch):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, block=block).collect()}
    assert got == brute(texts)


def test_traversal_over_many_leaves():
    rnd = random.Random(9)
    texts = [t for t in corpus(5) for _ in range(2)] + [" ".join(rnd.choice("abcdefgh") for _ in range(9)) for _ in range(300)]
    sets = [(i, shingles(t)) for i, t in enumerate(texts) if t and t.strip()]
    edges = jaccard_join.link_group([i for i, _ in sets], [len(s) for _, s in sets], [jaccard_join.bitmap(s, 8) for _, s in sets], [s for _, s in sets])
    of = dict(edges)
    want = brute(texts)
    assert {i: of.get(i, i) for i, _ in sets} == {i: want[i][1] for i, _ in sets}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "q r s t u v"), (9, "q r s t u v"), (4, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()) == [(-1, 2, None), (3, 2, 3), (3, 2, 3), (4, 0, 4), (9, 2, 3)]
    assert jaccard_components(docs.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(120)] + [(None, 5), (7, None)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: root(i) for i in parent}
