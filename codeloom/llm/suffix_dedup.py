"""Removal of repeated substrings with a common-prefix interval tree.

Two places that begin equal strings of `LENGTH` bytes also hold, at the same
distance from them, the same winnowed anchors: k-grams whose hash is least in a
window short enough to lie inside the string. So suffixes are only compared
where they begin at anchors of one k-gram. Each such group becomes an enhanced
suffix array (suffixes in order with the common prefix of neighbours); a stack
scan over it gives the intervals of the common-prefix tree, and in each interval
the contexts to the left show how far its members extend that way. An interval
of depth d whose members share l bytes to the left is a repeat of l + d bytes.

Places with one and the same context on both sides are one member with a count,
so a passage copied thousands of times reaches a group once; a group with more
distinct contexts than `BLOCK` is compared in pairs of blocks.

The same is done once more over words: a text is also the string of its words'
hashes, and its runs of `PASSAGE` words that another row holds too are counted.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, key_filter, materialize, may_hold, release
from .jaccard_join import word_hashes

LENGTH = 400
GRAM = 50
#: Words of a shared passage, words of a gram of them, bytes that stand for a word.
PASSAGE = 51
WORD_GRAM = 8
SYMBOL = 2
#: Contexts of one group that are compared at once.
BLOCK = 2048
#: Bytes hashed at once; longer texts are hashed in overlapping pieces.
CHUNK = 4 << 20

_ANCHORS = "key long, gram long, context long, n long, pos binary, left int, right int"
_CONTEXTS = "gram long, context long, owner long, body binary"
_REACH = "gram long, context long, l int, r int"
_SPANS = "key long, words boolean, a long, b long"
_SPAN_LIST = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

_TABLE = np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:8] for b in range(256)), dtype="<u8").astype(np.uint64)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _rolling(have: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` consecutive values, doubled up from halves."""
    by, power = {1: have}, {1: _MULTIPLIER}
    width = 1
    while width * 2 <= size:
        h = by[width]
        by[width * 2] = h[:-width] * power[width] + h[width:]
        power[width * 2] = np.multiply(*[np.array([power[width]])] * 2)[0]
        width *= 2
    out, done = by[width], width
    while done < size:
        add = 1 << ((size - done).bit_length() - 1)
        tail = by[add][done:]
        out = out[: len(tail)] * power[add] + tail
        done += add
    return _mix(out)


def _sliding(x: np.ndarray, size: int, best) -> np.ndarray:
    """best over each `size` consecutive values."""
    width = 1
    while width * 2 <= size:
        x = best(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return best(x[:-rest], x[rest:]) if rest else x


def _winnowed(have: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that are least in some `length - gram + 1` consecutive ones."""
    h = _rolling(have, gram)
    window = length - gram + 1
    least = _sliding(h, window, np.minimum)
    most = np.zeros(len(h) + window - 1, dtype=np.uint64)
    most[window - 1 : window - 1 + len(least)] = least
    own = np.flatnonzero(_sliding(most, window, np.maximum) == h)
    return own, h[own]


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, k-gram hashes) of the winnowed anchors of one text.

    A k-gram is an anchor where its hash is the least of some `length - gram + 1`
    consecutive ones; every string of `length` bytes holds one. `values` may give
    the hash of each element instead of bytes.
    """
    n = len(raw if values is None else values)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places, found = [], []
    step = max(CHUNK, 4 * length)
    for a in range(0, n - length + 1, step):
        # pieces overlap so that each window lies whole in one
        own, h = _winnowed(_TABLE[raw[a : a + step + length - 1]] if values is None else values[a : a + step + length - 1], length, gram)
        places.append(own + a)
        found.append(h)
    at, hashes = np.concatenate(places), np.concatenate(found)
    if len(places) > 1:
        at, first = np.unique(at, return_index=True)
        hashes = hashes[first]
    return at, hashes


def hashed_words(raw: bytes) -> np.ndarray:
    """The hash of each word of a text, long texts piece by piece between words."""
    if len(raw) <= CHUNK:
        return word_hashes(raw)
    out, a = [], 0
    while a < len(raw):
        b = a + CHUNK
        if b < len(raw):
            gap = _GAP.search(raw, b)
            b = gap.start() if gap else len(raw)
        out.append(word_hashes(raw[a:b]))
        a = b
    return np.concatenate(out)


def symbols(words: np.ndarray) -> bytes:
    """`SYMBOL` bytes for each word."""
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, -SYMBOL:].tobytes()


def _context(raw: bytes, at: int, length: int, gram: int) -> tuple[bytes, int]:
    """What lies around an anchor, as far as a string of `length` through it reaches."""
    left = min(at, length - gram)
    return raw[at - left : at + length], left


def _context_hash(body: bytes, left: int) -> int:
    digest = hashlib.blake2b(body, digest_size=8, salt=left.to_bytes(8, "little")).digest()
    return int.from_bytes(digest, "little", signed=True)


class Scale:
    """One of the two ways a text is read: as bytes (0) or as words (1)."""

    def __init__(self, length: int, gram: int, unit: int = 1):
        self.length, self.gram, self.unit = length, gram, unit

    def around(self, raw: bytes, at: int) -> tuple[bytes, int]:
        u = self.unit
        body, left = _context(raw, at * u, self.length * u, self.gram * u)
        return body, left


def _find_anchors(scales: tuple[Scale, Scale]):
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = hashed_words(raw)
                views = ((raw, anchors(np.frombuffer(raw, np.uint8), scales[0].length, scales[0].gram)), (symbols(words), anchors(words, scales[1].length, scales[1].gram, words)))
                for level, (view, (places, hashes)) in enumerate(views):
                    of, seen = scales[level], {}
                    # the last bit of a gram tells bytes from words
                    marked = (hashes & ~np.uint64(1) | np.uint64(level)).view(np.int64)
                    for at, h in zip(places.tolist(), marked.tolist()):
                        body, left = of.around(view, at)
                        own = (h, _context_hash(body, left), left, len(body) - left)
                        if own in seen:
                            seen[own].append(at)
                        else:
                            seen[own] = [at]
                    out += [(key, h, c, len(ats), ats[0].to_bytes(4, "little") if len(ats) == 1 else np.array(ats, "<u4").tobytes(), left // of.unit, right // of.unit) for (h, c, left, right), ats in seen.items()]
                if len(out) > 20_000:
                    yield _anchor_batch(out)
                    out = []
            if out:
                yield _anchor_batch(out)

    return run


def _anchor_batch(rows: list) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in _ANCHORS.split(", ")])


def _cut_contexts(scales: tuple[Scale, Scale]):
    """From (text, wanted anchors as (gram, context, owner, pos)) to what lies around each."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for text, wanted in zip(batch.column(0), batch.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                wanted = wanted.as_py()
                words = symbols(hashed_words(raw)) if any(w["gram"] & 1 for w in wanted) else b""
                for w in wanted:
                    level = w["gram"] & 1
                    body, left = scales[level].around(words if level else raw, w["pos"])
                    out.append((w["gram"], w["context"], w["owner"], left.to_bytes(4, "little") + body))
                    size += len(body)
                if size > 8 << 20:
                    yield _context_batch(out)
                    out, size = [], 0
            if out:
                yield _context_batch(out)

    return run


def _context_batch(rows: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], [x.split()[0] for x in _CONTEXTS.split(", ")])


def _common(a: np.ndarray, b: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of a and b, at most lens."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, lens)


def prefix_intervals(common: list[int]):
    """(depth, first, last) of every interval of the common-prefix tree, children
    before parents; common[i] is the shared prefix of suffixes i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def _order(contexts: np.ndarray, lens: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Rows by group, then bytes, then length."""
    order = np.argsort(lens, kind="stable")
    order = order[np.argsort(contexts[order].view(f"S{contexts.shape[1]}").ravel(), kind="stable")]
    return order[np.argsort(groups[order], kind="stable")]


def _tables(bodies: pa.Array, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Right contexts and reversed left contexts as rows of bytes, with their lengths."""
    at = np.frombuffer(bodies.buffers()[1], np.int32, len(bodies) + 1, 4 * bodies.offset).astype(np.int64)
    data = np.frombuffer(bodies.buffers()[2], np.uint8) if at[-1] else np.zeros(1, np.uint8)
    n_left = data[at[:-1, None] + np.arange(4)].copy().view("<u4").ravel().astype(np.int64)
    n_right = np.diff(at) - 4 - n_left
    middle, last = at[:-1] + 4 + n_left, len(data) - 1

    def rows(places, sizes, width):
        held = data[np.clip(places, 0, last)]
        held[np.arange(width) >= sizes[:, None]] = 0
        return held

    right = rows(middle[:, None] + np.arange(length), n_right, length)
    left = rows(middle[:, None] - 1 - np.arange(length - gram), n_left, length - gram)
    return right, n_right, left, n_left


def _range_minima(values: np.ndarray):
    """A function of (i, j) arrays, i < j, to the least of values[i:j]."""
    table = [values]
    while (half := 1 << (len(table) - 1)) < len(values):
        last = table[-1]
        table.append(np.append(np.minimum(last[:-half], last[half:]), last[-half:]))
    table = np.stack(table)

    def least(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        level = np.frexp(j - i)[1] - 1  # the largest power of two that fits
        return np.minimum(table[level, i], table[level, j - (1 << level)])

    return least


def _with_another(shared: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The most that each sorted member shares with one of another owner (-1:
    there is none), from what neighbours share (-1: not of one interval); `apart`
    tells neighbours of two owners. Along a run of one owner the least so far
    counts."""

    def sweep(beside: np.ndarray, new: np.ndarray) -> np.ndarray:
        floor = np.cumsum(new) << 20  # each run lies below the one before
        return np.minimum.accumulate(beside - floor) + floor

    new = apart | (shared < 0)
    ahead = sweep(np.append(-1, shared), np.append(True, new))
    back = sweep(np.append(-1, shared[::-1]), np.append(True, new[::-1]))[::-1]
    return np.maximum(ahead, back)


def reaches(bodies: pa.Array, groups: np.ndarray, length: int = LENGTH, gram: int = GRAM, owners: np.ndarray | None = None, at_once: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """How far left and right of its anchor each context is covered by repeats of
    at least `length` bytes shared with another context of its group (0, 0: not
    at all); with `owners`, another context of another owner.

    Bodies are distinct within a group: four bytes for how much lies left of the
    anchor, then the bytes. The members of many intervals are judged at once.
    """
    n = len(bodies)
    right, n_right, left, n_left = _tables(bodies, length, gram)
    order = _order(right, n_right, groups)  # the suffix array
    r, l, rl, ll, of = right[order], left[order], n_right[order], n_left[order], groups[order]
    whose = owners[order] if owners is not None else None
    common = np.where(of[:-1] == of[1:], _common(r[:-1], r[1:], np.minimum(rl[:-1], rl[1:])), 0)
    by_left = _order(l, ll, of)
    rank = np.empty(n, np.int64)  # place of each suffix in order of its left context
    rank[by_left] = np.arange(n)
    lasting = _range_minima(_common(l[by_left[:-1]], l[by_left[1:]], np.minimum(ll[by_left[:-1]], ll[by_left[1:]])))
    far_left, far_right = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def judge(intervals: list[tuple[int, int, int]]) -> None:
        depth, first, last = np.array(intervals, np.int64).T
        sizes = last - first + 1
        ends = np.cumsum(sizes)
        part = np.repeat(np.arange(len(sizes)), sizes)
        member = np.arange(ends[-1]) - np.repeat(ends - sizes - first, sizes)
        member = by_left[np.sort(part * n + rank[member]) % n]  # by left context within each interval
        a, b = member[:-1], member[1:]
        shared = np.full(len(a), -1, np.int64)
        beside = np.flatnonzero(part[:-1] == part[1:])
        shared[beside] = lasting(rank[a[beside]], rank[b[beside]])
        own = _with_another(shared, np.ones(len(shared), bool) if whose is None else whose[a] != whose[b])
        good = (own >= 0) & (own + depth[part] >= length)
        np.maximum.at(far_left, member[good], own[good])
        np.maximum.at(far_right, member[good], depth[part[good]])

    held: list[tuple[int, int, int]] = []
    size = 0
    for depth, first, last in prefix_intervals(common.tolist()):
        if depth >= gram:
            held.append((depth, first, last))
            size += last - first + 1
            if size > at_once:
                judge(held)
                held, size = [], 0
    if held:
        judge(held)
    out_l, out_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    out_l[order], out_r[order] = far_left, far_right
    return out_l, out_r


def _reach(scales: tuple[Scale, Scale], batch_size: int = 4096):
    """Over rows sorted by (gram, pair, context): whole groups, many at a time."""

    def solve(held: pa.RecordBatch):
        gram, pair, context, owner = (held.column(i).to_numpy() for i in range(4))
        same = (gram[1:] == gram[:-1]) & (pair[1:] == pair[:-1])
        once = np.append(True, ~(same & (context[1:] == context[:-1])))  # rows of one key bring a context again
        group = np.append(0, np.cumsum(~same))
        for level, of in enumerate(scales):
            some = np.flatnonzero(once & (gram & 1 == level))
            if len(some) < 2:
                continue
            l, r = reaches(held.column(4).take(pa.array(some)), group[some], of.length * of.unit, of.gram * of.unit, owner[some] if level else None)
            found = r > 0
            yield pa.record_batch([pa.array(gram[some][found]), pa.array(context[some][found]), pa.array((l[found] // of.unit).astype(np.int32)), pa.array((r[found] // of.unit).astype(np.int32))], [x.split()[0] for x in _REACH.split(", ")])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) <= batch_size:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            gram, pair = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            ends = np.flatnonzero((gram[1:] != gram[:-1]) | (pair[1:] != pair[:-1])) + 1
            if len(ends):  # all but the last group, which may go on
                yield from solve(whole.slice(0, int(ends[-1])))
                whole = whole.slice(int(ends[-1]))
            held = [whole]
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _joined(spans) -> list[list[int]]:
    """Sorted spans, joined where they touch."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


def _remove(batches):
    for batch in batches:
        ids, texts, spans, words = (batch.column(i) for i in range(4))
        rows = []
        for text, own, shared in zip(texts, spans, words):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            runs = _joined((x["a"], x["b"]) for x in own.as_py() or ())
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            said = sum(b - a for a, b in _joined((x["a"], x["b"]) for x in shared.as_py() or ()))
            rows.append((len(raw), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), said, [{"a": a, "b": b} for a, b in runs]))
        columns = list(zip(*rows)) or [()] * 6
        types = [pa.int64()] * 3 + [pa.string(), pa.int64(), _SPAN_LIST]
        yield pa.record_batch([ids, *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words", "spans"])


def _spread(batches):
    """(key, gram, pos, l, r) to its covered spans, one for each place, joined where they touch."""
    for batch in batches:
        keys, grams, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for key, gram, pos, l, r in zip(keys, grams, batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            last = None
            for at in np.sort(np.frombuffer(pos.as_py(), "<u4")).tolist():
                if last and at - l <= last[1]:
                    last[1] = at + r
                else:
                    if last:
                        rows.append((key, bool(gram & 1), *last))
                    last = [at - l, at + r]
            rows.append((key, bool(gram & 1), *last))
        columns = list(zip(*rows)) or [()] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64(), pa.int64()))], ["key", "words", "a", "b"])


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, passage: int = PASSAGE, word_gram: int = WORD_GRAM) -> DataFrame:
    """(key, spans, words): spans (a, b) of bytes covered by repeats, and of words
    in passages that another key holds too, for each key with any.

    `rows` has key and text; rows of one key must bear one text. Two hashes of 64
    bits (of the k-gram and of the context) stand for equal contexts; everything
    else compares bytes, or `SYMBOL` bytes for a word.
    """
    scales = Scale(length, gram), Scale(passage, word_gram, SYMBOL)
    found = materialize(rows.select("key", "text").mapInArrow(_find_anchors(scales), _ANCHORS), "anchors")
    grams = found.groupBy("gram").agg(F.sum("n").alias("places"), F.count("*").alias("rows"), F.min("key").alias("k0"), F.max("key").alias("k1"))
    grams = materialize(grams.where("CASE WHEN gram & 1 = 1 THEN k0 <> k1 ELSE places > 1 END").select("gram", "rows"), "grams")
    # both sides are plain tables: adaptive execution splits the partition of a very common gram
    places = materialize(found.join(grams, "gram"), "places")
    release(found)
    first = F.min(F.struct("key", "pos"))
    members = places.groupBy("gram", "context").agg(F.sum("n").alias("n"), first.alias("at"), F.max("key").alias("last"), F.max("left").alias("left"), F.max("right").alias("right"), F.max("rows").alias("rows"), F.count("*").alias("own"))
    members = materialize(members, "contexts")
    # the same context twice: all of it repeats, as far as a string through the anchor can reach
    again = F.when(F.col("gram").bitwiseAND(1) == 1, F.col("at.key") != F.col("last")).otherwise(F.col("n") > 1)
    twice = members.where(again).select("gram", "context", F.col("left").alias("l"), F.col("right").alias("r"))
    little = F.concat(F.substring("at.pos", 4, 1), F.substring("at.pos", 3, 1), F.substring("at.pos", 2, 1), F.substring("at.pos", 1, 1))
    owner = F.when(F.col("at.key") == F.col("last"), F.col("last")).otherwise(F.xxhash64("gram", "context"))
    # where a gram has more rows than this context of it, there are other contexts
    asked = materialize(members.where("own < rows").select(F.col("at.key").alias("key"), "gram", "context", "rows", owner.alias("owner"), F.conv(F.hex(little), 16, 10).cast("long").alias("pos")), "asked")
    wanted = asked.groupBy("key").agg(F.collect_list(F.struct("gram", "context", "owner", "pos")).alias("wanted"))
    texts = rows.select("key", "text").join(key_filter(asked, "key"), may_hold("key"), "left_semi").hint("merge").join(wanted, "key").select("text", "wanted")
    cut = texts.mapInArrow(_cut_contexts(scales), _CONTEXTS)
    blocks = F.ceil(F.col("rows") / block).cast("int")
    kinds = grams.where(F.col("rows") > block).select(F.col("gram").alias("g"), blocks.alias("blocks"))
    cut = cut.join(kinds, cut.gram == F.col("g"), "left").drop("g")
    mine = F.pmod(F.xxhash64("context"), F.coalesce("blocks", F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)).cast("long") - 1), lambda j: F.least(j, mine) * F.lit(1 << 31) + F.greatest(j, mine))
    cut = cut.withColumn("pair", F.explode(F.array_distinct(pairs)))
    dealt = cut.select("gram", "pair", "context", "owner", "body").repartition("gram", "pair").sortWithinPartitions("gram", "pair", "context")
    far = dealt.mapInArrow(_reach(scales), _REACH).unionByName(twice).groupBy("gram", "context").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    far = materialize(far, "reaches")
    hit = places.select("key", "gram", "context", "pos").join(far, ["gram", "context"]).select("key", "gram", "pos", "l", "r")
    span, words = F.struct("a", "b"), F.col("words")
    spans = hit.mapInArrow(_spread, _SPANS).groupBy("key").agg(F.collect_set(F.when(~words, span)).alias("spans"), F.collect_set(F.when(words, span)).alias("words"))
    out = materialize(spans, "spans")
    release(grams, places, members, asked, far)
    return out


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long, spans array<struct<a: long, b: long>>"


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, passage: int = PASSAGE, word_gram: int = WORD_GRAM) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): n_bytes, n_removed,
    n_spans, kept_sha256, n_shared_words and the removed spans (byte offsets, end
    exclusive).

    Every byte goes that a string of `length` bytes covers which also begins
    anywhere else, in another document or the same one, overlaps included, all
    judged on the input. n_shared_words counts the words in passages of at least
    `passage` words that another document holds too; they stay where no string of
    `length` bytes repeats. A null text is empty. Each row is a place of its
    own, whatever its doc_id: rows that repeat an identifier, and rows without
    one, are told apart by a 64-bit hash of identifier and text, and whole
    repeated rows lose all bytes of a text of `length` and more (for shared words
    they are one document). Texts shorter than `length` keep all bytes; long
    texts are read in overlapping pieces; an empty table gives no row; other
    columns are not read, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(rows, length, gram, block, passage, word_gram)
    some = key_filter(spans, "key")
    touched = rows.join(some, may_hold("key"), "left_semi").join(spans, "key", "left").select("doc_id", "text", "spans", "words").mapInArrow(_remove, OUT)
    body = F.coalesce("text", F.lit("")).cast("binary")
    whole = rows.join(some, may_hold("key"), "left_anti").select("doc_id", F.octet_length(body).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(body, 256).alias("kept_sha256"), F.lit(0).cast("long").alias("n_shared_words"), F.array().cast("array<struct<a: bigint, b: bigint>>").alias("spans"))
    return touched.unionByName(whole)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["a"], x["b"])), ",")
    return remove_repeats(documents(spark, sf_dir)).withColumn("spans", said)
