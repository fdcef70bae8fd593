"""Exact dedup with Patricia-trie owners.

Texts are grouped by byte length and content hash; inside a group the full byte
strings go into a compressed radix trie whose terminal nodes hold the smallest
identifier. Each scan task first owns its own texts in a local trie, so one text
copied over a third of all rows reaches the final trie once for each task.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, materialize, own_columns, rows_without


class Node:
    __slots__ = ("label", "children", "owner", "ties", "count")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.ties, self.count = label, {}, None, 0, 0

    def take(self, owner, ties: int, count: int) -> None:
        """Count rows in; null loses against any other identifier."""
        if owner == self.owner:
            self.ties += ties
        elif self.owner is None and not self.count or owner is not None and (self.owner is None or owner < self.owner):
            self.owner, self.ties = owner, ties
        self.count += count


class RadixTrie:
    """Compressed trie over byte strings; the terminal node of a string holds
    the smallest identifier, how many rows bear it, and the number of rows. `spill_bytes` bounds the
    strings held in memory: beyond it the largest subtree goes to a scratch file
    and its later strings follow it there; `items` reads each file back into a
    trie of its own."""

    NODE_BYTES = 400

    def __init__(self, spill_bytes: int = 64 << 20, scratch: str | None = None):
        self.root, self.bytes, self.limit, self.scratch = Node(b""), 0, spill_bytes, scratch
        self.spilled: list[tuple[bytes, str]] = []

    def insert(self, key: bytes, owner, ties: int = 1, count: int = 1) -> None:
        for prefix, path in self.spilled:
            if key.startswith(prefix):
                with open(path, "ab") as f:
                    pickle.dump((key, owner, ties, count), f)
                return
        node, i = self.root, 0
        while i < len(key):
            child = node.children.get(key[i])
            if child is None:
                node.children[key[i]] = leaf = Node(key[i:])
                self.bytes += len(leaf.label) + self.NODE_BYTES
                node, i = leaf, len(key)
                break
            if not key.startswith(child.label, i):
                child = self._split(node, child, key, i)
            node, i = child, i + len(child.label)
        node.take(owner, ties, count)
        if self.bytes > self.limit:
            self._spill()

    def _split(self, parent: Node, child: Node, key: bytes, i: int) -> Node:
        low, high = 1, min(len(child.label), len(key) - i)  # the first byte agrees
        while low < high:
            mid = (low + high + 1) // 2
            if child.label[:mid] == key[i : i + mid]:
                low = mid
            else:
                high = mid - 1
        top = Node(child.label[:low])
        child.label = child.label[low:]
        top.children[child.label[0]] = child
        parent.children[top.label[0]] = top
        self.bytes += self.NODE_BYTES
        return top

    @staticmethod
    def _walk(node: Node, prefix: bytes):
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.count:
                yield prefix, node.owner, node.ties, node.count
            stack.extend((c, prefix + c.label) for c in node.children.values())

    @staticmethod
    def _weight(node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.label) + RadixTrie.NODE_BYTES
            stack.extend(node.children.values())
        return total

    def _spill(self) -> None:
        node, prefix = self.root, b""
        while len(node.children) == 1 and not node.count:
            node = next(iter(node.children.values()))
            prefix += node.label
        if not node.children:
            self.limit *= 2  # one string alone is above the limit
            return
        child = max(node.children.values(), key=self._weight)
        fd, path = tempfile.mkstemp(prefix="trie-", dir=self.scratch)
        with os.fdopen(fd, "wb") as f:
            for entry in self._walk(child, prefix + child.label):
                pickle.dump(entry, f)
        self.bytes -= self._weight(child)
        del node.children[child.label[0]]
        self.spilled.append((prefix + child.label, path))

    def items(self):
        """(string, smallest identifier, rows with it, rows), and the scratch files go."""
        yield from self._walk(self.root, b"")
        self.root, self.bytes = Node(b""), 0
        while self.spilled:
            prefix, path = self.spilled.pop()
            part = RadixTrie(max(self.limit, 2 * os.path.getsize(path) // 8), self.scratch)
            try:
                with open(path, "rb") as f:
                    while True:
                        try:
                            part.insert(*pickle.load(f))
                        except EOFError:
                            break
            finally:
                os.unlink(path)
            yield from part.items()


LOCAL = "n_bytes long, sha binary, body binary, owner long, ties long, rows long"
_LOCAL_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
OWNERS = "n_bytes long, sha binary, keep_id long, ties long, group_size long"
_OWNER_TYPES = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def _own_locally(limit: int):
    def run(batches):
        trie = RadixTrie(1 << 62)

        def drain():
            out: list = []
            size = 0
            for key, owner, ties, rows in trie.items():
                out.append((len(key), hashlib.sha256(key).digest(), key, owner, ties, rows))
                size += len(key)
                if size > 8 << 20:
                    yield _batch(out, _LOCAL_TYPES, LOCAL)
                    out, size = [], 0
            if out:
                yield _batch(out, _LOCAL_TYPES, LOCAL)

        for batch in batches:
            for owner, key in zip(batch.column(0).to_pylist(), batch.column(1)):
                trie.insert(key.as_py(), owner)
                if trie.bytes > limit:
                    yield from drain()
        yield from drain()

    return run


def _own_finally(limit: int):
    def run(batches):
        trie = RadixTrie(limit)
        for batch in batches:
            owners, ties, rows, bodies = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(0)
            for i, body in enumerate(bodies):
                trie.insert(body.as_py(), owners[i], ties[i], rows[i])
        out = []
        for key, owner, ties, rows in trie.items():
            out.append((len(key), hashlib.sha256(key).digest(), owner, ties, rows))
            if len(out) == 4096:
                yield _batch(out, _OWNER_TYPES, OWNERS)
                out = []
        if out:
            yield _batch(out, _OWNER_TYPES, OWNERS)

    return run


def _batch(rows: list, types: list, schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def normalised(text) -> F.Column:
    """White-space runs become one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def text_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spill_bytes: int = 64 << 20) -> DataFrame:
    """(n_bytes, sha, keep_id, ties, group_size): one row for each distinct text;
    `ties` rows of it bear keep_id."""
    rows = docs.select(F.col(id_col).cast("long").alias("owner"), normalised(F.col(text_col).cast("string")).cast("binary").alias("body"))
    local = rows.mapInArrow(_own_locally(spill_bytes // 2), LOCAL)
    owners = local.repartition("n_bytes", "sha").select("body", "owner", "ties", "rows").mapInArrow(_own_finally(spill_bytes), OWNERS)
    return materialize(owners, "text-owners")


def _first_of_ties(rows: DataFrame) -> DataFrame:
    """`rows` (with sha, ties and kept) where of the rows of a text that tie one
    stays kept. The rows of a text are dealt to 1024 parts before any is ranked."""
    tied = F.col("kept") & (F.col("ties") > 1)
    dealt = rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    chosen = dealt.withColumn("at", F.row_number().over(Window.partitionBy("sha", "part").orderBy(tied.desc()))).withColumn("at", tied & (F.col("at") == 1))
    last = chosen.withColumn("part_", F.when(F.col("at"), -1).otherwise(F.col("part")))
    first = last.withColumn("first", F.row_number().over(Window.partitionBy("sha", "part_").orderBy("part")) == 1)
    return first.withColumn("kept", F.when(tied, F.col("at") & F.col("first")).otherwise(F.col("kept")))


MADE = ("keep_id", "group_size", "kept", "text_sha256")


def _hashed(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """(id, n_bytes, sha) of every row, and what else is asked for."""
    body = normalised(docs[text_col].cast("string"))
    return docs.select(docs[id_col].cast("long").alias("id"), F.octet_length(body).cast("long").alias("n_bytes"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("sha"), *more)


def _row(docs: DataFrame):
    """`row`, a struct of all columns of `docs`, so that no name of a column can
    hide one that is made."""
    return F.struct(*(docs[c] for c in docs.columns)).alias("row")


def _judged(docs: DataFrame, owners: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`row` beside the columns that are MADE."""
    joined = _hashed(docs, id_col, text_col, _row(docs)).join(owners, ["n_bytes", "sha"]).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))
    if _repeats(owners):  # one row of the ties stays
        joined = _first_of_ties(joined)
    return joined.withColumn("text_sha256", F.lower(F.hex("sha"))).select("row", *MADE)


def _repeats(owners: DataFrame) -> bool:
    """Whether several rows bear the smallest identifier of some text."""
    return not owners.where("ties > 1").isEmpty()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of `docs` with keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical after each white-space run becomes
    one space; long texts are compared whole. The row with the smallest
    identifier of a group is kept; where several rows bear it, one of them,
    whichever; so each text is kept once. A null text is the empty text; a null
    identifier loses against any other and is kept only where the whole group has
    none. An empty table gives an empty result. Columns of `docs` that bear a
    name of the result are replaced; all others stay, whatever their names.
    """
    made = _judged(docs, text_owners(docs, id_col, text_col), id_col, text_col)
    return made.select(*(F.col("row")[c].alias(c) for c in own_columns(docs, *MADE)), *MADE)


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `exact_dedup` keeps, all their columns as they are.

    Unless identifiers repeat, only hashes meet the owners, and only rows that
    may have to go are shuffled with their texts.
    """
    owners = text_owners(docs, id_col, text_col)
    columns = [F.col("row")[c].alias(c) for c in docs.columns]
    if _repeats(owners):
        return _judged(docs, owners, id_col, text_col).where("kept").select(*columns)
    gone = _hashed(docs, id_col, text_col).join(owners, ["n_bytes", "sha"]).where(~F.col("id").eqNullSafe(F.col("keep_id")))
    return rows_without(_hashed(docs, id_col, text_col, _row(docs)), materialize(gone.select("id", "sha"), "exact-copies"), "id", "sha", by=("id",)).select(*columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
