"""Bounded samples of labelled documents, and logistic calibration in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import crc_bucket

#: A longer text is learned from by so many evenly spaced blocks of this many characters in all, so that a sample fits the driver.
LONGEST_SAMPLE_CHARS = 50_000
SAMPLE_BLOCKS = 10


def sampled_text(column: str = "text"):
    """A text to learn from: the whole, or blocks from its beginning to its end."""
    size = LONGEST_SAMPLE_CHARS // SAMPLE_BLOCKS
    room = F.length(column) - size
    cut = [F.substr(F.col(column), (F.floor(room * i / (SAMPLE_BLOCKS - 1)) + 1).cast("int"), F.lit(size)) for i in range(SAMPLE_BLOCKS)]
    return F.when(F.length(column) <= LONGEST_SAMPLE_CHARS, F.col(column)).otherwise(F.concat_ws("\n", *cut))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, buckets: int, held_out: int) -> list[tuple[str, int]]:
    """At most ``per_class`` ids of either label outside the held-out bucket, the same ones each time, as (text, label).

    Null labels, null ids and null texts are left out; of contradicting labels the larger counts. Where ids repeat, the
    sample has at most ``4 * per_class`` rows.
    """
    known = labels.filter(F.col(column).isin(0, 1) & (crc_bucket("doc_id", buckets) != held_out)).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    picks = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picks = part if picks is None else picks.unionByName(part)
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(picks), "doc_id")
    rows = texts.orderBy(F.xxhash64("doc_id", "text")).limit(4 * per_class).select(sampled_text().alias("text"), "y").collect()
    return [(r["text"], r["y"]) for r in rows]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Coefficients, intercept last, by Newton steps on the ridge-penalised log-likelihood."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = logistic(x @ beta)
        grad = x.T @ (weight * (p - y)) + penalty * beta
        hess = (x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        beta = beta - step * min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return beta
