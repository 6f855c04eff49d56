"""A quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a shrunken covariance of the statistics, from sums that the tasks add up over all labelled rows. A text's
score is the logistic of the difference of the two log densities (Mahalanobis distances by Cholesky factors) plus the log prior odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import per_text, written
from evspark.llm.quality_rules import base_features
from evspark.llm.textscan import WHITE, groups, words_of

#: Shrinkage of a class's covariance towards the pooled one, and of both towards their diagonal; the ridge on standardised statistics.
TO_POOLED, TO_DIAGONAL, RIDGE = 0.2, 0.1, 0.02
#: A score of `predicted` = 1.
THRESHOLD = 0.3

_DIGITS, _STOPS, _COMMAS, _UPPER = b"0123456789", b".!?", b",;:", bytes(range(65, 91))
_ASCII = bytes(range(128))
FEATURES = 14


def statistics(texts: list[bytes]) -> np.ndarray:
    """The transformed statistics of each text in UTF-8, one row each; of an empty text, those of no words."""
    base = base_features(texts)
    out = np.empty((len(texts), FEATURES))
    for lo, hi in groups(texts):
        h, counts = words_of(texts[lo:hi])
        at = 0
        for i, n in zip(range(lo, hi), counts.tolist(), strict=True):
            t, own = texts[i], h[at : at + n]
            at += n
            many = lambda chars, t=t: len(t) - len(t.translate(None, chars))
            chars, words = max(1, int(base["word_chars"].iat[i])), max(1, n)
            lines = max(1, sum(1 for x in t.split(b"\n") if x.strip(WHITE)))
            share = lambda x, of: np.log((x + 0.5) / (of + 1.0))
            out[i] = (
                np.log1p(n),
                np.log(chars / words),
                share(base["n_symbols"].iat[i], chars),
                share(base["n_dup_lines"].iat[i], lines),
                share(base["n_repeat_words"].iat[i], words),
                share(len(t.translate(None, _ASCII)), chars),
                share(many(_DIGITS), chars),
                share(many(_STOPS), words),
                share(many(_COMMAS), words),
                share(many(_UPPER), chars),
                share(len(np.unique(own)), words),
                np.log(words / lines),
                share(t.count(b"|"), words),
                np.log1p(lines),
            )
    return out


@dataclass
class Discriminant:
    center: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]  # inverses of the Cholesky factors
    offset: float  # log prior odds and half the difference of the log determinants

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        far = [((f @ (z - m).T) ** 2).sum(axis=0) for m, f in zip(self.means, self.factors, strict=True)]
        return 1 / (1 + np.exp(-np.clip((far[0] - far[1]) / 2 + self.offset, -35, 35)))


def moments(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    return float(len(x)), x.sum(axis=0), x.T @ x


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """From the count, sum and sum of products of each class (0, 1). A class without rows gets the pooled covariance and a prior of half a row."""
    d = FEATURES
    none = (0.0, np.zeros(d), np.zeros((d, d)))
    (n0, s0, q0), (n1, s1, q1) = (sums.get(k, none) for k in (0, 1))
    n = max(1.0, n0 + n1)
    center = (s0 + s1) / n
    scale = np.sqrt(np.maximum(np.diag(q0 + q1) / n - center**2, 0)) + 1e-3
    means, covariances = [], []
    pooled = np.zeros((d, d))
    for m, s, q in ((n0, s0, q0), (n1, s1, q1)):
        mean = s / m if m else center
        own = q - m * np.outer(mean, mean)
        own = own / np.outer(scale, scale)
        pooled += own / n
        means.append((mean - center) / scale)
        covariances.append(own / m if m else None)
    factors, dets = [], []
    for c in covariances:
        c = pooled if c is None else (1 - TO_POOLED) * c + TO_POOLED * pooled
        c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c)) + RIDGE * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        dets.append(2 * np.log(np.diag(low)).sum())
    offset = np.log((n1 + 0.5) / (n0 + 0.5)) + (dets[0] - dets[1]) / 2
    return Discriminant(center, scale, tuple(means), tuple(factors), float(offset))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, x (the statistics) of each row of `docs`. A null text counts as empty."""
    return per_text(docs, id_col, text_col, pa.schema([("x", pa.list_(pa.float64()))]), lambda texts: [list(statistics([t.encode() for t in texts]))])


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def class_sums(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products of `x` for each `label`. Tasks send partial sums, Spark adds them; two rows of fixed width come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            label, x = batch.column(0).to_numpy(zero_copy_only=False), _rows(batch.column(1))
            for k in (0, 1):
                if (label == k).any():
                    n, s, q = moments(x[label == k])
                    total[k] = total.get(k, 0) + np.concatenate([[n], s, q.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["label", "v"])

    width = 1 + FEATURES + FEATURES**2
    parts = labelled.select(F.col("label").cast("int"), "x").mapInArrow(run, "label int, v array<double>")
    added = parts.select("label", F.posexplode("v").alias("at", "value")).groupBy("label", "at").agg(F.sum("value").alias("value"))
    sums = {k: np.zeros(width) for k in (0, 1)}
    for label, at, value in added.collect():
        sums[label][at] = value
    d = FEATURES
    return {k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in sums.items()}


def score_quality(docs: DataFrame, labels: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, held_out, score, predicted.

    `labels` has the id and `quality` (0 or 1; null and other values teach nothing); `held_out` is a SQL condition on the id, and rows
    for which it holds teach nothing. Rows of `labels` that repeat an id count once, by their mean. An empty text gets a score like
    any other; a null id is scored and not learned from. Without labels the score is 0.5.
    """
    x = written(features(docs, id_col, text_col), "statistics")
    known = labels.filter("quality IN (0, 1)").groupBy(id_col).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    model = fit(class_sums(x.filter(f"NOT ({held_out})").join(known, id_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_rows(batch.column(2)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = x.select(F.col(id_col).alias("id"), F.expr(f"coalesce({held_out}, true)").alias("held_out"), "x")
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
