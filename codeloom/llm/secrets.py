"""Secret scans: fixed patterns, and strings that a tokenizer finds hard.

Random strings fall apart into short tokens. Runs of credential characters whose
characters for each token stay low are reported, and so are their parts between
marks, since the words around a string must not hide it. Digests of known
lengths and UUIDs are set aside; a name is judged by its parts alone.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PIECE = re.compile(r"[A-Za-z0-9+_-]{16,}")
SEGMENT = re.compile(r"[A-Za-z0-9]{16,}")
#: Kinds in the order of the contract; the method's own kind comes last.
KINDS = ("assign", "access", "hex", "dense")
#: Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
HEXADECIMAL = re.compile(r"[0-9a-fA-F]+\Z")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: Words joined by marks, camel case with a number at the end, or a number: names, paths, versions and dates.
NAME = re.compile(r"[+/_=-]*+(?:(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]++)(?:[+/_=-]++|\Z))+\Z|(?:[A-Z]?[a-z]{2,}+)++[0-9]*\Z")
MAX_CHARS_PER_TOKEN = 2.0
OUT = "doc_id long, n_assign long, n_access long, n_hex long, n_dense long, base_sha256 string, spans string"

_vocabularies: dict = {}


def vocabulary(path: str):
    """The process's tiktoken encoding of a rank file."""
    if path not in _vocabularies:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _vocabularies[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _vocabularies[path]


def is_digest(run: str) -> bool:
    """A digest of a known length or a UUID, not a secret by itself."""
    return bool(HEXADECIMAL.match(run) and len(run) in DIGEST_LENGTHS or UUID.match(run))


def dense_in(run: str, coder, most: float, free) -> list[tuple[int, int]]:
    """(start, end) of what is hard in a run: all of it, else pieces between `=`
    and `/`, else segments of letters and digits. A name is never hard as a
    whole, a number never; `free` tells whether a span may be reported."""

    def hard(a: int, b: int) -> bool:
        return b - a < most * len(coder.encode_ordinary(run[a:b]))

    pieces = [m.span() for m in PIECE.finditer(run)]
    if not any(is_digest(run[a:b]) for a, b in pieces) and free(0, len(run)) and not NAME.match(run) and hard(0, len(run)):
        return [(0, len(run))]
    out = []
    for a, b in pieces:
        if is_digest(run[a:b]):
            continue
        if free(a, b) and not NAME.match(run[a:b]) and hard(a, b):
            out.append((a, b))
            continue
        for m in SEGMENT.finditer(run, a, b):
            if not is_digest(m[0]) and not m[0].isdigit() and free(*m.span()) and hard(*m.span()):
                out.append(m.span())
    return out


def spans_of(text: str, coder, most: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans of a text, in order; end is exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base, near, upto = sorted(found), [], 0
    for m in RUN.finditer(text):
        at = m.start()
        near = [s for s in near if s[2] > at]  # base spans that may touch this run: both are swept in order
        while upto < len(base) and base[upto][0] < m.end():
            near.append(base[upto])
            upto += 1
        free = lambda a, b: not any(x < at + b and at + a < y for x, _, y in near)  # noqa: B023, E731
        found += [(at + a, 3, at + b) for a, b in dense_in(m[0], coder, most, free)]
    return sorted(found)


def _scan(path: str, most: float):
    def run(batches):
        coder = vocabulary(path)
        for batch in batches:
            ids, rows = batch.column(0), []
            for text in batch.column(1):
                spans = spans_of(text.as_py() or "", coder, most)
                said = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
                base = ",".join(x for x, s in zip(said, spans) if s[1] < 3)
                counts = [sum(s[1] == k for s in spans) for k in range(4)]
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(said)))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.record_batch([pc.cast(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))], [x.split()[0] for x in OUT.split(", ")])

    return run


def scan_secrets(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """Counts and spans of every row.

    A null or empty text has no span; a long text is scanned whole; a null
    identifier stays null; repeated rows are scanned each; an empty table gives
    no row; other columns are not read, whatever their names. A span of the method that touches a base span is left to the base
    span. Offsets count code points, ends are exclusive, and spans that begin
    together are in the order of KINDS.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(vocabulary_path, max_chars_per_token), OUT)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scan_secrets(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
