"""Small numpy models and choosing of bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Logistic:
    """Logistic regression with a ridge penalty on standardised columns, fitted by Newton's method."""

    def __init__(self, ridge: float = 1.0):
        self.ridge = ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        weight = np.ones(len(x)) if weight is None else weight
        pen = np.full(z.shape[1], self.ridge)
        pen[-1] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(12):
            p = sigmoid(z @ w)
            g = z.T @ (weight * (p - y)) + pen * w
            h = (z * (weight * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ z + np.diag(pen)
            step = np.linalg.solve(h, g)
            w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-5:
                break
        self.w = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.w[:-1] + self.w[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def lowest(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """The n rows of lowest hash of doc_id: a bounded sample that does not depend on the order of rows."""
    return ids.where("doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)
