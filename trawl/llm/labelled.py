"""Bounded samples of labelled documents, and logistic calibration, for the two classifiers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, by: int) -> Column:
    """CRC-32 of the id as text, modulo ``by``; null ids have none."""
    return F.crc32(doc_id.cast("string")) % by


@dataclass
class Sample:
    texts: list[str]
    labels: np.ndarray
    #: Rows that each sampled row stands for.
    weights: np.ndarray


def sample(documents: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, most_chars: int, doc_id: str = "doc_id", text: str = "text") -> Sample:
    """At most ``per_class`` texts of either label, of at most ``most_chars`` characters each.

    The rows with the least MD5 of their id are taken, so reruns agree. Contradicting labels of one id count
    as 0. Only ids and texts that were chosen reach the driver.
    """
    known = labels.filter(usable & F.col(label).isin(0, 1)).groupBy(doc_id).agg(F.min(label).cast("int").alias("_y"))
    short = documents.select(doc_id, F.col(text).alias("_text")).filter(F.length("_text") <= most_chars)
    chosen = None
    for y in (0, 1):
        own = known.filter(F.col("_y") == y).orderBy(F.md5(F.col(doc_id).cast("string"))).limit(per_class)
        chosen = own if chosen is None else chosen.union(own)
    rows = short.join(F.broadcast(chosen), doc_id).groupBy(doc_id, "_y").agg(F.min("_text").alias("_text"))  # 2 * per_class ids at most
    found = sorted(map(tuple, rows.select(F.md5(F.col(doc_id).cast("string")), "_y", "_text").collect()))
    totals = {int(r["_y"]): r["count"] for r in known.groupBy("_y").count().collect()}
    y = np.array([r[1] for r in found], np.int64)
    n = np.bincount(y, minlength=2)
    weights = np.array([totals[k] / n[k] for k in y], float)
    return Sample([r[2] for r in found], y, weights / weights.mean() if len(y) else weights)


@dataclass
class Logistic:
    """A logistic model over standardised features; ``weights`` ends with the intercept."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> Logistic:
    """Weighted ridge regression of the log-odds by Newton's method; with one label only, its share, smoothed."""
    width = features.shape[1]
    if len(np.unique(labels)) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Logistic(np.zeros(width), np.ones(width), np.append(np.zeros(width), np.log(share / (1 - share))))
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack([(features - mean) / scale, np.ones(len(features))])
    penalty = np.diag(np.append(np.full(width, ridge * len(x)), 1e-9)) / 10
    w = np.zeros(width + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hessian = (x.T * (weights * p * (1 - p) + 1e-9)) @ x + penalty
        step = np.linalg.solve(hessian, x.T @ (weights * (p - labels)) + penalty @ w)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-9:
            break
    return Logistic(mean, scale, w)
