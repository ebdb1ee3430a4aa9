"""What the two classifiers share: a bounded labelled sample and Adam in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for null ids."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: dict[int, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class[y]`` labelled documents of each class, held-out fold excluded.

    Picks the ids of least hash in each class, so the sample is the same in every run. Repeated ids
    count once (largest label, least text); rows with a null id or label are not used.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    known = known.filter(fold("doc_id", modulus) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = None
    for y, most in per_class.items():
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    # its size is bounded by per_class, so it may be broadcast
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


class Adam:
    """Adam over named arrays, updated in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.params[k] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
