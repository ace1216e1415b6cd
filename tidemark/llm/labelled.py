"""Bounded samples of labelled rows and one-variable calibration, shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_rows, written


def fold(parts: int) -> Column:
    """crc32 of the doc_id as text, modulo the number of folds."""
    return F.crc32(F.col("doc_id").cast("string")) % F.lit(parts)


def part(parts: int) -> Column:
    """A number below ``parts`` by a hash of doc_id: the parts of the learning rows that calibrate each other."""
    return F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(parts)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Texts and labels of at most ``per_class`` rows of each class, and how many rows each class has.

    The rows are those of least hash of doc_id, so reruns agree.  The sample of
    labels is bounded by the parameter and therefore broadcast; documents are
    scanned once and not shuffled.  A doc_id with several labels counts once,
    with the greatest.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learn)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id", F.lit(label)), F.col("doc_id")]
    taken = known.where("label = 0").orderBy(*order).limit(per_class).unionByName(known.where("label = 1").orderBy(*order).limit(per_class))
    rows = text_rows(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").join(F.broadcast(taken), "doc_id")
    return written(rows, f"sample-{label}"), counts


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit on the standardised variable."""
    mean, scale = (float(x.mean()), float(x.std()) or 1.0) if len(x) else (0.0, 1.0)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * mean / scale)


def probability(x: np.ndarray, fit: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(fit[0] * x + fit[1], -700, 700)))


def class_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give the classes of a sample the shares they have among all labelled rows."""
    total, out = max(1, sum(counts.values())), np.ones(len(y))
    for c in (0, 1):
        here = int((y == c).sum())
        if here:
            out[y == c] = counts.get(c, 0) / total * len(y) / here
    return out
