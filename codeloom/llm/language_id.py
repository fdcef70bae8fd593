"""Language identification in two steps: the family, then the language in it.

Linear support vector machines over hashed character n-grams: one against the
rest tells the family; within a family one against one separates each pair of
close languages, and most wins decide.
"""

from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, draw
from .tokens import slices

#: At most so many training texts in all, shared evenly by the languages, those
#: first by a hash of their identifier.
MAX_TRAINING = 6000
DIMENSIONS = 2048
UNKNOWN = "und"
#: Families of common languages; any other code is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl"),
    "sinitic": ("zh", "yue"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "pa"),
    "turkic": ("tr", "az", "kk", "uz"),
    "uralic": ("fi", "hu", "et"),
}
#: What may be a letter; of these, numerals such as Roman ones are none.
LETTERS = re.compile(r"[^\W\d_]+")
CHUNK = 2 << 20
_ROWS = "lang string, x binary"
OUT = "doc_id long, lang_pred string, score double"


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's category L is in the text."""
    return any(m[0].isalpha() or any(map(str.isalpha, m[0])) for m in LETTERS.finditer(text))


def _count(raw: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Counts of hashed n-grams of one to three bytes; owner is the row of each byte, rows that of gaps."""
    wide = raw.astype(np.uint32)
    out = np.bincount(owner * 256 + raw, minlength=(rows + 1) * 256).reshape(-1, 256)[:rows]
    two = wide[:-1] << 8 | wide[1:]
    three = two[:-1] << 8 | wide[2:]
    n = DIMENSIONS - 256
    grams = np.zeros((rows, n))
    for keys, at in ((two, owner[:-1]), (three, owner[:-2])):
        h = ((keys * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(n)
        grams += np.bincount(at * n + h, minlength=(rows + 1) * n).reshape(-1, n)[:rows]
    return np.hstack([out, grams])


def vectors(texts: list[str]) -> np.ndarray:
    """One unit vector for each whole text: roots of hashed n-gram counts."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        if not held:
            return
        parts, owners = [], []
        for k, (_, raw) in enumerate(held):
            parts += [np.frombuffer(raw, np.uint8), np.zeros(2, np.uint8)]
            owners += [np.full(len(raw), k), np.full(2, len(held))]
        counts = _count(np.concatenate(parts), np.concatenate(owners).astype(np.int64), len(held))
        for (i, _), row in zip(held, counts):
            out[i] += row
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        raw = b" " + re.sub(r"[\W\d_]+", " ", text).lower().encode("utf-8", "replace") + b" "
        for a in range(0, len(raw), CHUNK):
            held.append((i, raw[a : a + CHUNK + (2 if a + CHUNK < len(raw) else 0)]))
            size += len(held[-1][1])
            if size > CHUNK or len(held) >= 256:
                flush()
                size = 0
    flush()
    out = np.sqrt(out)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """A linear support vector machine of squared hinge loss, by accelerated gradients; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost
    w = v = np.zeros(x.shape[1])
    rate = 1 / (1e-2 + 2 * float(weight.sum()) * 2)
    for k in range(steps):
        gap = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (1e-2 * v - 2 * ((weight * y * gap) @ x))
        v = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1].astype(np.float32), float(w[-1])


def train(docs: DataFrame, max_training: int = MAX_TRAINING) -> dict:
    """Machines for families and for pairs, from text and lang of at most
    `max_training` rows that are not held out; null languages and texts without
    a letter teach nothing; rows that repeat an identifier teach each. Beyond
    `max_training` languages the most frequent are learned.

    A language's rows are those with the lowest hashes of their identifier. A
    hash bound from its count leaves about twice as many as are wanted, so that
    only these are ranked and moved.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    found = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_training).collect()
    if not found:
        return {"families": {}, "family": {}, "pair": {}}
    quota = max(1, max_training // len(found))
    bounds = docs.sparkSession.createDataFrame([(r.lang, (2.0 * quota + 100) / r.n) for r in found], "of string, bound double")
    drawn = known.select("doc_id", "lang", "text", draw(F.col("doc_id"), 0).alias("u")).join(F.broadcast(bounds), (F.col("lang") == F.col("of")) & (F.col("u") < F.col("bound")))
    order = Window.partitionBy("lang").orderBy("u", "doc_id", F.xxhash64("text"))
    picked = drawn.withColumn("n", F.row_number().over(order)).where(F.col("n") <= quota).select("doc_id", "text", "lang")
    rows = picked.mapInArrow(_describe, _ROWS).toArrow().to_pylist()
    got = sorted(((r["lang"], r["x"]) for r in rows if r["x"] is not None))
    if not got:
        return {"families": {}, "family": {}, "pair": {}}
    x = np.array([np.frombuffer(v, "<f4") for _, v in got])
    lang = np.array([code for code, _ in got])
    family_of = {code: name for name, codes in FAMILIES.items() for code in codes}
    families: dict[str, list[str]] = {}
    for code in sorted(set(lang)):
        families.setdefault(family_of.get(code, code), []).append(str(code))
    own = np.array([family_of.get(code, code) for code in lang])
    family = {f: fit_svm(x, np.where(own == f, 1.0, -1.0)) for f in families} if len(families) > 1 else {}
    pair = {}
    for codes in families.values():
        for a, b in combinations(codes, 2):
            both = (lang == a) | (lang == b)
            pair[a, b] = fit_svm(x[both], np.where(lang[both] == a, 1.0, -1.0))
    return {"families": families, "family": family, "pair": pair}


def _sure(margin: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, 4 * margin))))


def predict(x: np.ndarray, model: dict) -> list[tuple[str, float]]:
    """The language of each vector and how sure both steps are together."""
    names = list(model["families"])
    if not names:
        return [(UNKNOWN, 0.0)] * len(x)
    first = np.stack([x @ w + b for w, b in (model["family"][f] for f in names)], axis=1) if model["family"] else np.zeros((len(x), 1))
    pairs = {k: x @ w + b for k, (w, b) in model["pair"].items()}
    out = []
    for i, row in enumerate(first):
        best = int(row.argmax())
        rest = np.delete(row, best)
        sure = _sure((row[best] - rest.max()) / 2) if len(rest) else 1.0
        codes = model["families"][names[best]]
        wins = dict.fromkeys(codes, 0.0)
        for a, b in combinations(codes, 2):
            m = float(pairs[a, b][i])
            wins[a if m >= 0 else b] += 1 + _sure(abs(m)) / len(codes)
        code = max(sorted(wins), key=wins.get)
        closest = [(m if a == code else -m) for (a, b), m in ((k, float(pairs[k][i])) for k in combinations(codes, 2)) if code in (a, b)]
        out.append((code, sure * (_sure(min(closest)) if closest else 1.0)))
    return out


def _describe(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        rows: list = []
        for a, b in slices([len(t) for t in texts], 128, CHUNK):
            rows += [v.astype("<f4").tobytes() if has_letter(t) else None for t, v in zip(texts[a:b], vectors(texts[a:b]))]
        yield pa.record_batch([batch.column(2), pa.array(rows, pa.binary())], ["lang", "x"])


def _predict(model: dict):
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found: list = []
            for a, b in slices([len(t) for t in texts], 128, CHUNK):
                part = predict(vectors(texts[a:b]), model)
                found += [p if has_letter(t) else (UNKNOWN, 0.0) for t, p in zip(texts[a:b], part)]
            yield pa.record_batch([batch.column(0), pa.array([c for c, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row.

    A text that is null or has no letter (Unicode category L) is `und` with score
    0, and so is every text where nothing was learned; ties go to the first code;
    repeated rows are predicted alike; a null identifier stays null; a long text
    is counted whole, in overlapping pieces; an empty table gives no row; other
    columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), OUT)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = identify(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
