"""Small learners in numpy: histogram gradient-boosted trees, isotonic calibration; and labelled samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(of: int, column: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod of; null for a null doc_id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(of))


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, rows: int) -> DataFrame:
    """At most `rows` labelled documents outside the held-out part, a row each: (doc_id, text, label).

    Those with the least hashes of doc_id are taken, so reruns agree. Rows without a label or doc_id take no
    part; of several labels the largest counts, of several texts of a doc_id the least.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most `rows` pairs of numbers
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BoostedTrees:
    """Logistic loss, trees of fixed depth over binned features. A tree is arrays of features and thresholds in heap order."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, leaf: int = 5, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.leaf, self.ridge = rounds, depth, rate, bins, leaf, ridge
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        n, m = x.shape
        p = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        if n == 0 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            q = sigmoid(score)
            g, h = y - q, q * (1 - q)
            node, tree = np.zeros(n, np.int64), []
            for level in range(self.depth):
                feature, cut, found = self._splits(binned, edges, node, g, h, 1 << level)
                tree.append((feature, cut, np.array([edges[f][c] if ok else np.inf for f, c, ok in zip(feature, cut, found, strict=True)])))
                node = 2 * node + np.where(found[node], binned[feature[node], np.arange(n)] > cut[node], False)
            value = self.rate * np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.ridge)
            score += value[node]
            self.trees.append(([(f, t) for f, _, t in tree], value))
        return self

    def _splits(self, binned, edges, node, g, h, nodes):
        best, feature, cut = np.full(nodes, 1e-6), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        for j, e in enumerate(edges):
            k = len(e) + 1
            if k < 2:
                continue
            at = node * k + binned[j]
            sg, sh, sn = (np.cumsum(np.bincount(at, w, nodes * k).reshape(nodes, k), axis=1) for w in (g, h, None))
            gain = sg**2 / (sh + self.ridge) + (sg[:, -1:] - sg) ** 2 / (sh[:, -1:] - sh + self.ridge) - sg[:, -1:] ** 2 / (sh[:, -1:] + self.ridge)
            gain[(sn < self.leaf) | (sn[:, -1:] - sn < self.leaf)] = 0
            at = gain[:, :-1].argmax(axis=1)
            top = gain[np.arange(nodes), at]
            better = top > best
            best[better], feature[better], cut[better] = top[better], j, at[better]
        return feature, cut, best > 1e-6

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for levels, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, threshold in levels:
                node = 2 * node + (x[rows, feature[node]] > threshold[node])
            out += value[node]
        return sigmoid(out)


class Isotonic:
    """The monotone step function nearest to the labels, by pooling adjacent violators; linear between block centres."""

    def __init__(self, score: np.ndarray, y: np.ndarray):
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # mean, weight, sum of scores
        for s, t in zip(score[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([float(t), 1.0, s])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                mean, n, at = blocks.pop()
                last = blocks[-1]
                last[0] = (last[0] * last[1] + mean * n) / (last[1] + n)
                last[1] += n
                last[2] += at
        self.x = np.array([b[2] / b[1] for b in blocks] or [0.5])
        self.y = np.array([b[0] for b in blocks] or [0.5])

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.x, self.y), 0.0, 1.0)
