"""Bounded labelled samples, Adam and segment softmax for the models trained here."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_ids(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """doc_id, label of about ``bound`` rows of each label (0 and 1), at most all of them.

    Ids labelled both ways, null ids and other labels are left out.  Which rows are
    taken depends on a hash of the id only, so every run takes the same.  The rate is
    set from the counts, so the sample stays near the bound however many rows there are.
    """
    clean = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    clean = clean.where("lo = hi").select("doc_id", F.col("lo").cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in clean.groupBy("label").count().collect()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    rate = F.when(F.col("label") == 1, int(1e6 * min(1, bound / max(1, counts.get(1, 0))))).otherwise(int(1e6 * min(1, bound / max(1, counts.get(0, 0)))))
    return clean.where(part < rate)


def segment_softmax(x: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Softmax within runs of rows; ``owner`` names each row's run."""
    e = np.exp(x - np.maximum.reduceat(x, starts)[owner])
    return e / np.add.reduceat(e, starts)[owner]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Adam over a dict of arrays, changed in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
