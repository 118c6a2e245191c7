"""Labelled rows for the classifiers: one label a document, joined to its text, and bounded samples of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of up to this many rows (24 bytes each) are sent to the documents; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal digits modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)).cast("int")


def one_label(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label 0 or 1): where rows disagree the majority counts, at a tie the larger. Null labels teach nothing."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(column).cast("double").alias("y")).dropna()
    return known.groupBy("doc_id").agg(F.avg("y").alias("y")).select("doc_id", (F.col("y") >= 0.5).cast("int").alias("label"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join on doc_id; the labels are broadcast only if they are few, else both sides are shuffled."""
    few = labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(labels) if few else labels, "doc_id")


def at_most(rows: DataFrame, n: int, seed: int, by: str | None = None) -> DataFrame:
    """About n rows (n of each value of `by`), chosen by a hash of doc_id: distributed, the same on each run.

    Where there are more, the share that gives n is kept; hashes decide, so no sort or single task is needed.
    """
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    if by is None:
        return rows.where(chance < min(1.0, n / max(1, rows.count())))
    counts = {r[by]: r["count"] for r in rows.groupBy(by).count().collect()}
    share = F.lit(0.0)
    for value, count in counts.items():
        share = F.when(F.col(by) == value, min(1.0, n / count)).otherwise(share)
    return rows.where(chance < share)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 60) -> np.ndarray:
    """Weights by Newton's method for logistic loss with an L2 penalty; few columns."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (p - y) + l2 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w
