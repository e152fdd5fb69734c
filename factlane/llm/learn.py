"""What the trained classifiers share: labelled samples of bounded size, and calibration."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import remainder


def learnable(labels: DataFrame) -> DataFrame:
    """Labels that models may learn from: not those whose crc32(doc_id) mod 4 is 2."""
    return labels.where(remainder("doc_id", 4) != 2)


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: str) -> DataFrame:
    """``text``, ``label`` (0 or 1) and ``fold`` (0..3) of at most ``per_class`` labelled texts of each class.

    The ids with the smallest seeded hashes; only those ids are looked up in ``docs``, and of rows with equal ids the
    one whose text has the smallest hash is taken.
    """
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"))
    light = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    light = light.distinct().withColumn("_h", hashed)
    picked = None
    for value in (0, 1):
        some = light.where(F.col("label") == value).orderBy("_h", "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    fold = F.pmod(F.col("_h"), F.lit(4)).cast("int")
    # at most 2 * per_class ids
    ids = F.broadcast(picked.select("doc_id", "label", fold.alias("fold")))
    found = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "label", "fold")
    return found.agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "label", "fold")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (the constant first) of a logistic curve, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


def for_share(curve: np.ndarray, sampled: float, share: float) -> np.ndarray:
    """The curve for a population where the class has ``share``, not the sample's part ``sampled``."""
    limit = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    odds = [math.log(limit(p) / (1 - limit(p))) for p in (share, sampled)]
    return curve + np.array([odds[0] - odds[1]] + [0.0] * (len(curve) - 1))
