"""N-gram Jaccard self-join with signature trees.

A document is the set of its five-word shingles, each a 64-bit hash; equal sets
become one class. Two sets of Jaccard similarity s share none of the K lowest
hashes of their union with probability (1 - s)^K at most, so classes only meet
where they share one of their K lowest hashes: at 0.8 and K = 24 a link is missed
once in 10^16, as rare as a clash of the hashes themselves.

Classes that meet are compared by signature trees: leaves hold classes in order
of size, nodes the OR of their members' token bitmaps and their size range, and
a dual traversal drops node pairs whose largest possible overlap is too small.
The first traversal works on bitmaps alone and yields candidate components; the
second holds the full sets of one component and tests every pair that bitmaps
leave, but for pairs already joined. Both emit one edge for each class at most,
never all pairs of a group; groups above `BLOCK` members are compared in pairs of
blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, documents, key_filter, materialize, may_hold, rows_without

WORDS = 5
LOWEST = 24
BLOCK = 2048
LEAF = 32
FANOUT = 8
_SETS = "doc_id long, n long, h1 long, h2 long, keys array<long>, bits binary"
_EDGES = "src long, dst long"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.frombuffer(b"".join(hashlib.sha256(b"w%d" % b).digest()[:8] for b in range(256)), dtype="<u8").astype(np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_powers = np.cumprod(np.full(256, _M, dtype=np.uint64))


def _power(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(2 * n, _M, dtype=np.uint64))
    return _powers


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word of a text, in order."""
    data = np.frombuffer(raw, np.uint8)
    solid = ~_SPACE[data]
    starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]])) if len(data) else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.uint64)
    ends = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1
    data, solid, shift = data[starts[0] : ends[-1]], solid[starts[0] : ends[-1]], starts[0]
    starts, ends = starts - shift, ends - shift
    lengths = np.diff(np.append(starts, len(data)))
    within = np.arange(len(data)) - np.repeat(starts, lengths)
    values = np.where(solid, _TABLE[data] * _power(int(lengths.max()))[within], np.uint64(0))
    return _mix(np.add.reduceat(values, starts) + (ends - starts).astype(np.uint64) * _M)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    h = word_hashes((text or "").encode("utf-8", "replace").lower())
    if not len(h):
        return h
    size = min(words, len(h))
    out = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = out * _M + h[k : len(h) - size + 1 + k]
    return np.unique(_mix(out + np.uint64(size)))


def bitmap(s: np.ndarray, bits_each: int = 1) -> np.ndarray:
    """A token bitmap of a power of two bits, at least `bits_each` for a token."""
    width = max(64, 1 << int(len(s) * bits_each - 1).bit_length())
    out = np.zeros(width, dtype=np.uint8)
    out[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little")


class Joined:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def roots(self, at: np.ndarray) -> np.ndarray:
        p = self.parent
        while True:
            up = p[p]
            if (up == p).all():
                break
            p[:] = up
        return p[at]


class SignatureTree:
    """Levels of nodes over classes in order of size; level 0 are the leaves."""

    def __init__(self, members: np.ndarray, sizes: np.ndarray, maps: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.members, self.sizes = members[order], sizes[order].astype(np.int64)
        self.maps = np.ascontiguousarray(maps[order]).view(np.uint64)
        #: tokens beyond one for each bit: what bitmaps may hide of an overlap
        self.slack = self.sizes - np.bitwise_count(self.maps).sum(axis=1, dtype=np.int64)
        n = len(self.members)
        starts = np.arange(0, n, LEAF)
        level = [np.bitwise_or.reduceat(self.maps, starts), np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts), np.maximum.reduceat(self.slack, starts)]
        self.levels = [level]
        while len(level[1]) > 1:
            at = np.arange(0, len(level[1]), FANOUT)
            level = [np.bitwise_or.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at)]
            self.levels.append(level)

    def folded(self) -> SignatureTree:
        """The same classes with bitmaps of half the width."""
        half = self.maps.shape[1] // 2
        return SignatureTree(self.members, self.sizes, self.maps[:, :half] | self.maps[:, half:])

    def leaf(self, k: int) -> slice:
        return slice(k * LEAF, (k + 1) * LEAF)


def _may_link(overlap, size_a, size_b):
    """100 * overlap >= 80 * union, for a largest possible overlap."""
    return 180 * overlap >= 80 * (size_a + size_b)


def dual_traversal(a: SignatureTree, b: SignatureTree, joined: Joined, test) -> None:
    """Join all linked pairs of a and b (a may be b); `test` judges a pair that
    the bitmaps leave, None takes it."""
    same = a is b
    todo = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while todo:
        la, i, lb, j = todo.pop()
        oa, lo_a, hi_a, slack_a = (x[i] for x in a.levels[la])
        ob, lo_b, hi_b, slack_b = (x[j] for x in b.levels[lb])
        if 5 * hi_a < 4 * lo_b or 5 * hi_b < 4 * lo_a:
            continue
        most = min(int(np.bitwise_count(oa & ob).sum()) + min(slack_a, slack_b), hi_a, hi_b)
        if not _may_link(most, lo_a, lo_b):
            continue
        if la == 0 and lb == 0:
            _leaves(a, i, b, j, joined, test)
        elif la >= lb:
            below = range(i * FANOUT, min((i + 1) * FANOUT, len(a.levels[la - 1][1])))
            if same and la == lb and i == j:
                todo += [(la - 1, x, la - 1, y) for x in below for y in below if x <= y]
            else:
                todo += [(la - 1, x, lb, j) for x in below]
        else:
            todo += [(la, i, lb - 1, y) for y in range(j * FANOUT, min((j + 1) * FANOUT, len(b.levels[lb - 1][1])))]


def _leaves(a: SignatureTree, i: int, b: SignatureTree, j: int, joined: Joined, test) -> None:
    x, y = a.leaf(i), b.leaf(j)
    ma, mb = a.members[x], b.members[y]
    apart = joined.roots(ma)[:, None] != joined.roots(mb)[None, :]
    if a is b and i == j:
        apart = np.triu(apart, 1)
    if not apart.any():
        return
    both = np.bitwise_count(a.maps[x][:, None, :] & b.maps[y][None, :, :]).sum(axis=2, dtype=np.int64)
    most = both + np.minimum(a.slack[x][:, None], b.slack[y][None, :])
    left = apart & _may_link(most, a.sizes[x][:, None], b.sizes[y][None, :])
    for p, q in zip(*np.nonzero(left)):
        p, q = int(ma[p]), int(mb[q])
        if joined.root(p) != joined.root(q) and (test is None or test(p, q)):
            joined.join(p, q)


def link_group(ids: list[int], sizes: list[int], maps: list[np.ndarray], sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Edges (member, smallest member) of the components of one group."""
    n = len(ids)
    joined = Joined(n)

    def test(p: int, q: int) -> bool:
        a, b = (sets[p], sets[q]) if len(sets[p]) <= len(sets[q]) else (sets[q], sets[p])
        at = np.searchsorted(b, a)
        overlap = int((b[np.minimum(at, len(b) - 1)] == a).sum())
        return _may_link(overlap, len(a), len(b))

    first: dict[int, int] = {}  # rows of one identifier are one node
    for k, i in enumerate(ids):
        joined.join(first.setdefault(i, k), k)
    widths = np.array([len(m) for m in maps])
    trees = {int(w): SignatureTree(at := np.flatnonzero(widths == w), np.array(sizes)[at], np.stack([maps[k] for k in at])) for w in np.unique(widths)}
    for w, tree in trees.items():
        dual_traversal(tree, tree, joined, sets and test)
        if 2 * w in trees:
            dual_traversal(tree, trees[2 * w].folded(), joined, sets and test)
    least: dict[int, int] = {}
    roots = joined.roots(np.arange(n)).tolist()
    for i, r in zip(ids, roots):
        least[r] = min(least.get(r, i), i)
    return [(i, least[r]) for i, r in zip(ids, roots) if i != least[r]]


def _groups(batches, keys: int):
    """Whole groups of rows sorted by their first `keys` columns."""
    held, now = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now:
                if len(held) > 1:
                    yield held
                held, now = [], row[:keys]
            held.append(row[keys:])
    if len(held) > 1:
        yield held


def _edge_batches(found):
    out: list[tuple[int, int]] = []
    for edges in found:
        out += edges
        if len(out) > 20_000:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["src", "dst"])
            out = []
    if out:
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["src", "dst"])


def _by_bitmaps(batches):
    yield from _edge_batches(link_group([r[0] for r in g], [r[1] for r in g], [np.frombuffer(r[2], np.uint8) for r in g]) for g in _groups(batches, 2))


def _by_sets(words: int):
    def run(batches):
        def solve(g):
            sets = [shingles(text, words) for _, text in g]
            return link_group([i for i, _ in g], [len(s) for s in sets], [bitmap(s, 8) for s in sets], sets)

        yield from _edge_batches(solve(g) for g in _groups(batches, 2))

    return run


def _describe(words: int, lowest: int):
    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                s = shingles(text.as_py(), words)
                signed = s.view(np.int64)
                if len(s):
                    h1, h2 = int(_mix(s + _M).view(np.int64).sum()), int(np.bitwise_xor.reduce(_mix(s ^ _M)).astype(np.uint64).view(np.int64))
                    rows.append((len(s), h1, h2, signed[:lowest].tolist(), bitmap(s).tobytes()))
                else:
                    rows.append((0, 0, 0, [], b""))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.binary()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n", "h1", "h2", "keys", "bits"])

    return run


def _in_blocks(rows: DataFrame, group: str, member: str, count: str, block: int) -> DataFrame:
    """Adds `pair`, the pair of blocks of a group above `block` members in which
    a row is compared; each two rows of a group share one."""
    blocks = F.ceil(F.col(count) / block).cast("int")
    mine = F.pmod(F.xxhash64(member), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.concat_ws("-", F.least(j, mine), F.greatest(j, mine)))
    return rows.withColumn("pair", F.explode(F.when(blocks > 1, F.array_distinct(pairs)).otherwise(F.array(F.lit("")))))


def jaccard_components(docs: DataFrame, words: int = WORDS, lowest: int = LOWEST, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs` (doc_id, text).

    Two documents link when 100 * intersection >= 80 * union of their shingle
    sets; component_id is the smallest doc_id reachable by links. A text of fewer
    words is one shingle of them all; a null or wordless text has none and is
    its own component; rows that repeat an identifier are one node; a null
    identifier links with nothing and its component is null; a long text is
    described whole; an empty table gives no row; other columns are not read,
    whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = materialize(rows.mapInArrow(_describe(words, lowest), _SETS), "shingle-sets")
    full = sets.where("n > 0 AND doc_id IS NOT NULL")
    same = ["n", "h1", "h2"]
    classes = full.groupBy(*same).agg(F.min("doc_id").alias("rep"))
    heads = full.join(classes.withColumnRenamed("rep", "doc_id"), [*same, "doc_id"], "left_semi").dropDuplicates([*same, "doc_id"])
    heads = materialize(heads, "shingle-classes")

    keys = heads.select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key"))
    met = keys.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).where("c > 1")
    buckets = met.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key", "c")  # one of the buckets of the same members
    dealt = _in_blocks(keys.join(buckets, "key"), "key", "rep", "c", block)
    signed = dealt.join(heads.select(F.col("doc_id").alias("rep"), "n", "bits"), "rep").select("key", "pair", "rep", "n", "bits")
    near = signed.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_by_bitmaps, _EDGES)
    candidates = materialize(connected_components(near), "shingle-candidates")

    counted = candidates.join(candidates.groupBy("component").agg(F.count("*").alias("c")), "component")
    # merged at every size: a broadcast that small tables get would not last
    held = rows.join(key_filter(candidates, "node"), may_hold("doc_id"), "left_semi").hint("merge")
    texts = held.join(_in_blocks(counted, "component", "node", "c", block), held.doc_id == F.col("node")).select("component", "pair", "node", "text")
    links = texts.repartition("component", "pair").sortWithinPartitions("component", "pair").mapInArrow(_by_sets(words), _EDGES)
    joined = connected_components(links)

    named = classes.join(joined, classes.rep == F.col("node"), "left").select(*same, F.coalesce("component", "rep").alias("component"))
    slim = sets.select("doc_id", *same)
    linked = slim.where("n > 0 AND doc_id IS NOT NULL").join(named, same).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    alone = slim.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def near_distinct_rows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Of each component of near duplicates the row with the smallest identifier
    (nulls last), all columns as they are; rows that link with nothing stay.

    Rows are told apart by a 64-bit hash of identifier and text, so that repeated
    and null identifiers are judged by their texts; rows that agree in both stay
    or go together. An empty table gives no row.
    """
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    parts = materialize(jaccard_components(rows.select(F.col("key").alias("doc_id"), "text"), words).where("n_shingles > 0").select(F.col("doc_id").alias("key"), F.col("component_id").alias("part")).distinct(), "near-parts")
    large = parts.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part")
    members = parts.join(large, "part", "left_semi").join(rows.select("id", "key"), "key")
    members = materialize(members, "near-members")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    gone = members.join(members.groupBy("part").agg(F.min(rank).alias("first")), "part").where("key <> first.key").select("key").distinct()
    return rows_without(rows, materialize(gone, "near-copies"), "key").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * k >= 80 * (a.n + b.n - k)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, e.y FROM r JOIN e ON r.c = e.x)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.d = n.doc_id GROUP BY n.doc_id, n.n
"""
