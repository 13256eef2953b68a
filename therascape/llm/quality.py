"""Quality classifier: naive Bayes support vectors (operator 5).

Indicators of word unigrams, word bigrams and word-end shapes, hashed to 2**20 slots, are scaled by their class
log-count ratios; on these a linear hinge-loss model is fitted by dual coordinate descent, and a logistic curve
fitted on margins of a part left out of the descent turns margins into probabilities.  The fit uses at most
``TRAIN_ROWS`` labelled rows outside the held-out fold (a documented bound: feature lists of that many rows reach
the driver); every document is scored from its whole text.

Defined results: null and empty texts get the score of the intercept alone; repeated rows get equal scores; without
labels, or with one class only, every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from therascape.llm.common import table
from therascape.llm.features import held_out, training_rows, word_slots

TRAIN_ROWS = 8000
BITS = 20
SIZE = 1 << BITS
THRESHOLD = 0.7


def _slot_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = [word_slots(x.as_py(), BITS).astype("<i4").tobytes() for x in batch.column("text")]
        yield pa.record_batch({"y": batch.column("y").cast(pa.int32()), "slots": pa.array(slots, pa.binary())})


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 12) -> np.ndarray:
    """Linear hinge-loss weights by dual coordinate descent; y is 1 or -1, the last weight is the intercept."""
    w, alpha = np.zeros(SIZE + 1), np.zeros(len(y))
    norm = np.array([v @ v + 1.0 for v in values])
    order, rng = np.arange(len(y)), np.random.default_rng(5)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            x, v = rows[i], values[i]
            grad = y[i] * (w[x] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - grad / norm[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                w[-1] += step
                alpha[i] = new
    return w


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of y (0 or 1) over margins, by Newton steps with smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum()])
        h = p * (1 - p)
        m = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        d = np.linalg.solve(m, g)
        a, b = max(a - d[0], 1e-3), b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(a), float(b)


class Model:
    def __init__(self, rows: list[np.ndarray], y: np.ndarray):
        self.share = float(y.mean()) if len(y) else 0.5
        self.w = None
        if len(set(y.tolist())) < 2:
            return
        sums = [np.bincount(np.concatenate([r for r, k in zip(rows, y, strict=True) if k == c] or [np.zeros(0, np.int64)]), minlength=SIZE) + 1.0 for c in (1, 0)]
        ratio = np.log(sums[0] / sums[0].sum()) - np.log(sums[1] / sums[1].sum())
        values = [ratio[r] / np.sqrt(max(len(r), 1)) for r in rows]
        part = np.arange(len(y)) % 5 == 4
        fit = lambda keep: descend([r for r, k in zip(rows, keep, strict=True) if k], [v for v, k in zip(values, keep, strict=True) if k], 2.0 * y[keep] - 1)
        self.a, self.b = 1.0, 0.0
        if part.sum() > 20 and len(set(y[part].tolist())) == 2 and len(set(y[~part].tolist())) == 2:
            w = fit(~part)
            margin = np.array([w[r] @ v + w[-1] for r, v, k in zip(rows, values, part, strict=True) if k])
            self.a, self.b = _curve(margin, y[part])
        w = fit(np.ones(len(y), bool))
        self.w, self.bias = (w[:-1] * ratio).astype(np.float32), w[-1]

    def score(self, slots: np.ndarray) -> float:
        if self.w is None:
            return self.share
        m = float(self.w[slots].sum()) / np.sqrt(max(len(slots), 1)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.a * m + self.b, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> Model:
    rows = training_rows(docs, labels, label, most).select("y", "text").mapInArrow(_slot_lists, "y int, slots binary").collect()
    rows.sort(key=lambda r: (bytes(r["slots"]), r["y"]))
    order = np.random.default_rng(5).permutation(len(rows))
    return Model([np.frombuffer(rows[i]["slots"], "<i4").astype(np.int64) for i in order], np.array([int(rows[i]["y"]) for i in order], np.int64))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, score) for every input row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**20 weights of four bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [sent.value.score(word_slots(x.as_py(), BITS)) for x in batch.column("text")]
            yield pa.record_batch({"row": batch.column("row"), "score": pa.array(score, pa.float64())})

    src = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(run, T.StructType([src.schema["row"], T.StructField("score", T.DoubleType())]))


def op5_quality_nbsvm(spark, sf_dir):
    """Every document of ``documents``: its quality score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels"))).select(F.col("row.doc_id").alias("doc_id"), "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
