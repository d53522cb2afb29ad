"""Labelled rows to learn from: a bounded sample outside the held-out fold, joined to its texts."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled documents that a model is fitted on.
SAMPLE = 20_000


def fold(folds: int) -> Column:
    """crc32 of the doc_id as text modulo ``folds``; null for rows without id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(folds))


def held_out(folds: int, left: int) -> Column:
    return F.coalesce(fold(folds) == left, F.lit(False))


def first_by_hash(rows: DataFrame, names: Sequence[str], size: int) -> DataFrame:
    """At most ``size`` of distinct rows, the first by the hash of ``names``; all of them if they are no more.

    A cut of the uniform hash six deviations above the wanted share goes before the sort, so that the one task that ends
    it gets little more than ``size`` rows from however many partitions.
    """
    n = rows.count()
    if n <= size:
        return rows
    key, share = F.xxhash64(*names), (size + 6 * math.sqrt(size) + 16) / n
    if share < 1:
        rows = rows.where(key < int((share - 0.5) * 2.0**64))
    return rows.orderBy(key, *names).limit(size)


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, left: int, size: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, text, label): at most ``size``, of at most ``size`` labelled ids, each the first by hash.

    Ids of fold ``left``, null ids and labels other than 0 and 1 are left out; an id labelled both ways counts as 1. Of rows
    that repeat an id every text is taken; if that makes more than ``size`` rows, equal rows count once and the first
    ``size`` by hash of id and text stay.
    """
    ids = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    ids = first_by_hash(ids.where(fold(folds) != left).groupBy("doc_id").agg(F.max("label").alias("label")), ["doc_id"], size)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = texts.join(F.broadcast(ids), "doc_id")  # at most ``size`` rows of two numbers
    return rows if rows.count() <= size else first_by_hash(rows.distinct(), ["doc_id", "text"], size)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits with the least log loss on held-back rows, searched on a fine scale."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
    loss = [np.mean(np.logaddexp(0, logits / t) - y * logits / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


class Net:
    """Two layers: tanh units, then one logit; fitted by Adam on standardised inputs, calibrated by temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 3):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        back = order[: len(x) // 5]
        fit = order[len(x) // 5 :]
        z = self.inputs(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(np.log(rate / (1 - rate)))]
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(max(epochs, 800 * 256 // max(256, len(fit)))):
            fit = rng.permutation(fit)
            for lo in range(0, len(fit), 256):
                own = fit[lo : lo + 256]
                h = np.tanh(z[own] @ self.w[0] + self.w[1])
                d = (sigmoid(h @ self.w[2] + self.w[3]) - y[own]) / len(own)
                dh = np.outer(d, self.w[2]) * (1 - h * h)
                grads = [z[own].T @ dh + 1e-4 * self.w[0], dh.sum(axis=0), h.T @ d + 1e-4 * self.w[2], d.sum()]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.heat = 1.0
        if len(back):
            self.heat = temperature(self.logits(x[back]), y[back])

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.inputs(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.heat)
