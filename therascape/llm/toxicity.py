"""Toxicity severity by cumulative-link ordinal regression (operator 7).

P(grade > k) = sigmoid(w . x - threshold_k): one weight vector over sparse word features, shared across ordered
thresholds.  Labels say toxic or not; the grades above 0 come from how many telling words a toxic document
has (each counts one plus the log of its occurrences), cut at its thirds.  Features are the ``FEATURES``
slots of words and word beginnings most associated with the label (chi-square), each with one plus the log of its count.  The model is fitted on at
most ``TRAIN_ROWS`` labelled rows outside the held-out fold; every document is scored from its whole text.

The result is the expected severity, the sum over k of P(grade > k); a document is toxic if P(grade > 0) >= 0.5.
Defined results: null and empty texts have no features and get the thresholds' own severity; repeated rows get equal
scores; without labels of both kinds nothing is toxic and severity is 0; texts of any length are read whole; an empty table gives an
empty result; the input's columns come back inside ``row``, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from therascape.llm.common import free_memory, table
from therascape.llm.features import SIZE, held_out, training_rows, word_counts

TRAIN_ROWS = 8000
FEATURES = 1024
#: A feature is at least so many times as common in toxic documents as in others, and in so many of them.
TELLING = 12
LEAST = 3
GRADES = 4


def _count_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [word_counts(x.as_py()) for x in batch.column("text")]
        yield pa.record_batch(
            {
                "y": batch.column("y").cast(pa.int32()),
                "slots": pa.array([s.astype("<i4").tobytes() for s, _ in found], pa.binary()),
                "counts": pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary()),
            }
        )


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    def __init__(self, slots: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray):
        self.column = None
        n, toxic = len(y), int(y.sum())
        if not 0 < toxic < n:
            return
        with_word = [np.bincount(np.concatenate([s for s, k in zip(slots, y, strict=True) if k == c]), minlength=SIZE).astype(float) for c in (1, 0)]
        a, b = with_word
        c, d = toxic - a, n - toxic - b
        chi = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * toxic * (n - toxic), 1)
        chi[(a * (n - toxic) <= TELLING * (b + 1) * toxic) | (a < LEAST)] = 0  # only words that tell of toxicity
        best = np.argsort(-chi, kind="stable")[:FEATURES]
        best = best[chi[best] > 10.8]  # 0.001 level, one degree of freedom
        self._take(best)
        told = np.array([(1 + np.log(k[self.column[s] >= 0])).sum() for s, k in zip(slots, counts, strict=True)])
        cuts = np.quantile(told[y == 1], [1 / 3, 2 / 3])
        grade = np.where(y == 1, 1 + (told > cuts[0]) + (told > cuts[1]), 0)
        self._descend(*self._matrix(slots, counts), grade, len(best))

    def _take(self, best: np.ndarray) -> None:
        self.best, self.column = best, np.full(SIZE, -1, np.int32)
        self.column[best] = np.arange(len(best))

    def arrays(self) -> dict[str, np.ndarray]:
        """What is kept of the model; ``restored`` makes it again."""
        return {} if self.column is None else {"best": self.best.astype("<i8"), "w": self.w.astype("<f8"), "theta": self.theta.astype("<f8")}

    @classmethod
    def restored(cls, a: dict[str, np.ndarray]) -> Model:
        model = cls([], [], np.zeros(0, np.int64))
        if a:
            model._take(a["best"])
            model.w, model.theta = a["w"], a["theta"]
        return model

    def _matrix(self, slots: list[np.ndarray], counts: list[np.ndarray]):
        cols = [self.column[s] for s in slots]
        row = np.repeat(np.arange(len(slots)), [int((c >= 0).sum()) for c in cols])
        col = np.concatenate([c[c >= 0] for c in cols]) if cols else np.zeros(0, np.int32)
        val = np.concatenate([1 + np.log(k[c >= 0]) for k, c in zip(counts, cols, strict=True)]) if cols else np.zeros(0)
        return row, col, val

    def _descend(self, row, col, val, grade, n_features: int, steps: int = 100, ridge: float = 1e-5, tolerance: float = 1e-9) -> None:
        """Newton steps on the sum over thresholds of logistic losses until no part of the gradient is above the tolerance.

        The loss is convex in weights and thresholds; grades are nested, so its thresholds come out in order.  The thresholds' own tiny
        ridge only keeps them finite where a grade has no row.  ``row`` ascends.
        """
        n, m, k = len(grade), n_features, GRADES - 1
        over = (grade[:, None] > np.arange(k)).astype(float)
        keep = np.concatenate([np.full(m, ridge), np.full(k, 1e-9)])
        x = np.concatenate([np.zeros(m), 1.0 + np.arange(k)])
        margins = lambda x: np.bincount(row, x[col] * val, n)[:, None] - x[m:]
        loss = lambda x: (lambda z: np.logaddexp(0, np.where(over > 0, -z, z)).sum() / n + keep @ (x * x) / 2)(margins(x))
        blocks = range(0, n, 1024)
        cuts = np.searchsorted(row, [*blocks, n])
        for _ in range(steps):
            p = _sigmoid(margins(x))
            e = (p - over) / n
            g = np.concatenate([np.bincount(col, e.sum(1)[row] * val, m), -e.sum(0)]) + keep * x
            if np.abs(g).max() <= tolerance:
                break
            bend, curve = p * (1 - p) / n, np.diag(keep)
            for first, i, j in zip(blocks, cuts, cuts[1:]):
                d = bend[first : first + 1024]
                part = np.zeros((len(d), m))
                np.add.at(part, (row[i:j] - first, col[i:j]), val[i:j])
                curve[:m, :m] += part.T @ (d.sum(1)[:, None] * part)
                curve[:m, m:] -= part.T @ d
            curve[m:, :m] = curve[:m, m:].T
            curve[m:, m:] += np.diag(bend.sum(0))
            move, here, t = np.linalg.solve(curve, g), loss(x), 1.0
            while t > 1e-10 and loss(x - t * move) > here - 1e-4 * t * (g @ move) + 1e-15:
                t /= 2
            x = x - t * move
        self.w, self.theta = x[:m], x[m:]

    def over(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        if self.column is None:
            return np.zeros(GRADES - 1)
        c = self.column[slots]
        return _sigmoid(self.w[c[c >= 0]] @ (1 + np.log(counts[c >= 0])) - self.theta)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(x.as_py(), y.as_py(), z.as_py()) for b in batches for x, y, z in zip(b.column("slots"), b.column("counts"), b.column("y"), strict=True)]
    rows.sort()
    ints = lambda k: [np.frombuffer(r[k], "<i4") for r in rows]
    found = Model(ints(0), ints(1), np.array([r[2] for r in rows], np.int64)).arrays()
    del rows
    free_memory()
    if found:
        yield pa.record_batch({k: pa.array([v.tobytes()], pa.binary()) for k, v in found.items()})


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_ROWS) -> Model:
    """The model of at most ``most`` rows, fitted in one task; the driver gets its features and weights alone."""
    rows = training_rows(docs, labels, label, most).select("y", "text").mapInArrow(_count_lists, "y int, slots binary, counts binary")
    found = rows.repartition(1).mapInArrow(_fitted, "best binary, w binary, theta binary").first()
    return Model.restored({k: np.frombuffer(v, "<i8" if k == "best" else "<f8") for k, v in found.asDict().items()} if found else {})


def graded(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, p_toxic, severity, grade) for every input row; grade is the likeliest one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over = np.array([sent.value.over(*word_counts(x.as_py())) for x in batch.column("row").field(text_col).cast(pa.binary())]).reshape(-1, GRADES - 1)
            each = -np.diff(np.column_stack([np.ones(len(over)), over, np.zeros(len(over))]), axis=1)
            yield pa.record_batch({"row": batch.column("row"), "p_toxic": pa.array(over[:, 0], pa.float64()), "severity": pa.array(over.sum(1), pa.float64()), "grade": pa.array(each.argmax(1), pa.int32())})

    src = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return src.mapInArrow(run, T.StructType([src.schema["row"]]).add("p_toxic", "double").add("severity", "double").add("grade", "integer"))


def keep_clean(docs: DataFrame, labels: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """The input's rows and columns without toxic documents; ``train`` holds the texts of the labels (default: the input)."""
    out = graded(docs, fit(docs if train is None else train, labels)).where("p_toxic < 0.5")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op7_toxicity_ordinal(spark, sf_dir):
    """Every document of ``documents``: expected severity, likeliest grade and whether it is toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = graded(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("row.doc_id").alias("doc_id"), "severity", "grade", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic")).withColumn("held_out", held_out())
