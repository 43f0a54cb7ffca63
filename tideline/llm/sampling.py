"""Bounded samples of labelled documents for fitting classifiers, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F


def fold(doc_id, folds: int):
    """crc32 of the doc_id's decimal text, modulo ``folds``; a null doc_id is in no fold (-1)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> DataFrame:
    """(doc_id, text, label, weight) of at most ``per_class`` training rows of each class, picked by hash order.

    ``weight`` is the number of labelled rows that a sampled row stands for. The sampled ids are at most ``2 * per_class``
    longs, so they are broadcast; texts are not shuffled. A doc_id with several labels counts with its largest.
    """
    known = (labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
             .groupBy("doc_id").agg(F.max("label").alias("label")).where(fold("doc_id", folds) != held_out))
    size = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = None
    for one, count in size.items():
        part = known.where(F.col("label") == one).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).withColumn(
            "weight", F.lit(max(1.0, count / per_class)))
        picked = part if picked is None else picked.union(part)
    if picked is None:
        picked = known.withColumn("weight", F.lit(1.0))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if not len(x):
        return w
    scale = weight / weight.sum()
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (scale * (p - y)) + penalty * w
        step = np.linalg.solve((x * (scale * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
