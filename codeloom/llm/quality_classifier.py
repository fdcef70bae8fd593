"""Quality classifier by Bradley-Terry pairwise ranking.

All preference pairs (a row of label 1 over a row of label 0) give a logistic loss
on feature differences; its weights score every document. A quantile of the
training scores gives the threshold, and the score in [0, 1] is a logistic of
the distance to it.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, unused

#: At most so many labelled rows are fitted on, those first by a hash of their identifier.
MAX_LABELLED = 20_000
#: Pairs that are held at once; the sums go over all of them.
PAIRS_AT_ONCE = 1 << 20
#: The score at the threshold; the contract predicts 1 from here on.
AT_THRESHOLD = 0.3
FEATURES = 14
_ROWS = "doc_id long, x binary"


def _class_table() -> np.ndarray:
    """The class of each byte: 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 sentence mark, 6 other mark, 7 beyond ASCII."""
    table = np.zeros(256, dtype=np.int64)
    for b in range(256):
        c = chr(b)
        table[b] = 7 if b >= 128 else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in " \t\n\x0b\x0c\r" else 5 if c in ".,;:?'-" else 6 if 33 <= b < 127 else 0
    return table


_CLASS = _class_table()


def features(text: str | None) -> np.ndarray:
    """Shares of byte classes, words and lines of a whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n = max(1, len(raw))
    share = np.bincount(_CLASS, weights=np.bincount(raw, minlength=256), minlength=8) / n
    words = text.split()
    k = max(1, len(words))
    distinct = len(set(words)) / k
    same = sum(map(eq, words, words[1:])) / k
    lines = [x for x in text.split("\n") if x]
    again = 1 - len(set(lines)) / max(1, len(lines))
    return np.array([math.log1p(len(words)), math.sqrt(share[2]), math.sqrt(share[3]), share[4], share[5], math.sqrt(share[6]), share[0], min(1.0, share[6] * 4), min(1.0, share[2] * 2), distinct, same, math.sqrt(same), again, min(20.0, n / k) / 20])


def _describe(batches):
    for batch in batches:
        ids, rows = batch.column(0), [features(t.as_py()).astype("<f8").tobytes() for t in batch.column(1)]
        yield pa.record_batch([ids, pa.array(rows, pa.binary())], ["doc_id", "x"])


def fit_ranking(x: np.ndarray, good: np.ndarray, ridge: float = 1e-3) -> dict:
    """Weights of the logistic loss over all pairs, and the threshold: the quantile
    of the training scores that errs least, moved to the middle between the scores
    on both sides of it where it parts the labels."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1.0
    z = (x - mean) / spread
    wins, losses = z[good], z[~good]
    w = np.zeros(z.shape[1])
    if len(wins) and len(losses):
        n, some = len(wins) * len(losses), max(1, PAIRS_AT_ONCE // len(losses))
        for _ in range(30):  # Newton steps of sum log(1 + exp(-d.w)) for d = win - loss
            grad, hess, over = np.zeros(len(w)), np.zeros((len(w), len(w))), np.zeros(len(losses))
            lost = losses @ w
            for i in range(0, len(wins), some):
                a = wins[i : i + some]
                p = 1 / (1 + np.exp(np.clip((a @ w)[:, None] - lost, -30, 30)))
                grad -= p.sum(axis=1) @ a - p.sum(axis=0) @ losses
                p *= 1 - p
                cross = a.T @ (p @ losses)
                hess += (a * p.sum(axis=1)[:, None]).T @ a - cross - cross.T
                over += p.sum(axis=0)
            grad = grad / n + ridge * w
            hess = (hess + (losses * over[:, None]).T @ losses) / n + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-7:
                break
        scores = z @ w
        # the quantile, near the share of label 0, that errs least for both labels
        grid = np.quantile(scores, np.linspace(0, 1, 1001))
        errors = [np.mean(scores[good] < t) + np.mean(scores[~good] >= t) for t in grid]
        best = np.flatnonzero(np.isclose(errors, min(errors)))
        high = scores[good & (scores >= grid[best[-1]])].min() if (good & (scores >= grid[best[-1]])).any() else grid[best[-1]]
        low = scores[~good & (scores < grid[best[0]])].max() if (~good & (scores < grid[best[0]])).any() else grid[best[0]]
        threshold = (high + low) / 2 if low < high else float(grid[best[0]])
    else:  # one label only: everything is of it
        threshold = -1.0 if len(wins) else 1.0
    return {"mean": mean, "spread": spread, "w": w, "threshold": float(threshold)}


def score_of(x: np.ndarray, model: dict) -> float:
    z = float(((x - model["mean"]) / model["spread"]) @ model["w"]) - model["threshold"]
    z += math.log(AT_THRESHOLD / (1 - AT_THRESHOLD))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict:
    """Fit on at most `max_labelled` labelled rows that are not held out.

    Rows of null label or identifier are left out; a document labelled twice
    counts once for each label; of rows that repeat an identifier the one with
    the least features counts; without labels everything scores above the
    threshold. Ties in the order of labelled rows go by identifier and label.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    sample = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id", "quality").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi").mapInArrow(_describe, _ROWS).groupBy("doc_id").agg(F.min("x").alias("x")).toArrow().to_pylist()
    labelled: dict[int, list[int]] = {}
    for r in sample.collect():
        labelled.setdefault(r.doc_id, []).append(r.quality)
    found = sorted(((r["doc_id"], r["x"], q) for r in rows for q in labelled[r["doc_id"]]), key=lambda t: (t[0], t[1], t[2]))
    if not found:
        return {"mean": np.zeros(FEATURES), "spread": np.ones(FEATURES), "w": np.zeros(FEATURES), "threshold": -1.0}
    return fit_ranking(np.array([np.frombuffer(x, "<f8") for _, x, _ in found]), np.array([q == 1 for *_, q in found]))


def _score(model: dict, name: str):
    def run(batches):
        for batch in batches:
            scores = [score_of(features(t.as_py()), model) for t in batch.column(batch.num_columns - 1)]
            yield pa.record_batch([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], name])

    return run


def _scored(docs: DataFrame, model: dict, keep: list[str], score: str) -> DataFrame:
    """The columns `keep` and `score`; the text goes to Python once more."""
    (text,) = unused([*keep, score], "text")
    rows = docs.select(*(docs[c] for c in keep), docs["text"].cast("string").alias(text))
    return rows.mapInArrow(_score(model, score), rows.select(*keep).schema.add(score, "double"))


def score_quality(docs: DataFrame, model: dict, columns: list[str] | None = None) -> DataFrame:
    """`columns` of every row of `docs` (default: all) with score and predicted.

    A null text scores like the empty one; a text of any length is read whole;
    ties with the threshold are predicted 1; repeated rows score alike; a null
    identifier stays null; an empty table gives no row. Columns of `docs` named
    score or predicted are replaced; all others stay, whatever their names.
    """
    keep = [c for c in (columns or docs.columns) if c.lower() not in ("score", "predicted")]
    return _scored(docs, model, keep, "score").withColumn("predicted", (F.col("score") >= AT_THRESHOLD).cast("int"))


def accepted_rows(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of `docs` that are predicted 1, all their columns as they are."""
    (score,) = unused(docs.columns, "score")
    return _scored(docs, model, docs.columns, score).where(F.col(score) >= AT_THRESHOLD).drop(score)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_quality(docs, model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
