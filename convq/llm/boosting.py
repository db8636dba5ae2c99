"""Gradient-boosted trees: of a few thousand rows on the driver, or of a table of any size on Spark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

#: Rows of a block, and parts of one that gradients are rounded to: whole numbers add up alike in any order.
BLOCK, SCALE = 10_000, float(1 << 24)


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: per tree and inner node a feature and a threshold, per leaf a value."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        depth = int(np.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            z += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _best_split(x, gradient, hessian, ridge):
    """The feature and threshold of the largest gain; a threshold no row passes if none gains."""
    best, whole = (0.0, 0, np.inf), gradient.sum() ** 2 / (hessian.sum() + ridge)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        value, g, h = x[order, j], np.cumsum(gradient[order]), np.cumsum(hessian[order])
        cut = np.flatnonzero(value[1:] > value[:-1])
        if not len(cut):
            continue
        left = g[cut] ** 2 / (h[cut] + ridge)
        right = (g[-1] - g[cut]) ** 2 / (h[-1] - h[cut] + ridge)
        k = int(np.argmax(left + right))
        gain = left[k] + right[k] - whole
        if gain > best[0] + 1e-9:
            best = (gain, j, (value[cut[k]] + value[cut[k] + 1]) / 2)
    return best[1], best[2]


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss; ``y`` is 0 or 1, both must occur."""
    rate_of_ones = float(y.mean())
    start = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    z, inner = np.full(len(y), start), 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        gradient, hessian = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for n in range(inner):
            here = node == n
            if here.sum() > 1:
                feature[n], threshold[n] = _best_split(x[here], gradient[here], hessian[here], ridge)
            right = x[here, feature[n]] > threshold[n]
            node[here] = 2 * n + 1 + right
        leaf = np.zeros(2**depth)
        for k in range(2**depth):
            here = node - inner == k
            leaf[k] = rate * gradient[here].sum() / (hessian[here].sum() + ridge)
        z += leaf[node - inner]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), start)


@dataclass(frozen=True)
class _Grown:
    """A tree over places in the sorted values of each feature; a row goes right if its place is above ``cut``."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def nodes(self, places: np.ndarray, depth: int) -> np.ndarray:
        node, rows = np.zeros(len(places), np.int64), np.arange(len(places))
        for _ in range(depth):
            node = 2 * node + 1 + (places[rows, self.feature[node]] > self.cut[node])
        return node


def _blocks(values: list[np.ndarray]):
    def blocks(rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        while some := list(islice(rows, BLOCK)):
            x = np.array([r["x"] for r in some], float)
            places = np.stack([np.searchsorted(v, x[:, j]) for j, v in enumerate(values)], axis=1)
            yield places.astype(np.int32), np.array([r["label"] for r in some], float), np.array([r["n"] for r in some], np.int64)

    return blocks


def _sums(start: float, grown: list[_Grown], tree: _Grown, depth: int, level: int, offsets: np.ndarray):
    """Gradients and hessians of a block, added up per node of ``level`` and value of each feature."""

    def sums(block: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        places, y, n = block
        z = np.full(len(y), start)
        for g in grown:
            z += g.leaf[g.nodes(places, depth) - (len(g.leaf) - 1)]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        node = tree.nodes(places, level) - (2**level - 1)
        out = np.zeros((2, 2**level, offsets[-1]), np.int64)
        at = node[:, None], offsets[:-1] + places
        for k, each in enumerate((y - p, p * (1 - p))):
            np.add.at(out[k], at, (np.rint(each * SCALE).astype(np.int64) * n)[:, None])
        return out

    return sums


def _best_cut(gradient: np.ndarray, hessian: np.ndarray, offsets: np.ndarray, ridge: float):
    """Feature and place of the largest gain, and gradient and hessian to its left; a place that none passes if none gains."""
    g, h = gradient[: offsets[1]].sum(), hessian[: offsets[1]].sum()
    best, whole = (0.0, 0, np.iinfo(np.int32).max, g, h), g**2 / (h + ridge)
    for j, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        here = np.flatnonzero(hessian[a:b])  # values that rows of this node have
        left_g, left_h = np.cumsum(gradient[a:b][here])[:-1], np.cumsum(hessian[a:b][here])[:-1]
        if not len(left_g):
            continue
        gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - whole
        k = int(np.argmax(gain))
        if gain[k] > best[0] + 1e-9:
            best = (gain[k], j, int(here[k]), left_g[k], left_h[k])
    return best[1:]


def fit_counted(rows: DataFrame, trees: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Trees | None:
    """Boosting as in ``fit_trees`` on all of ``rows``: ``label boolean, x array<double>, n bigint``, n being how often it counts.

    None without both labels.  Rows stay where they are.  Each level of a tree is one job that adds
    up gradients per node and value of each feature; these sums, of at most two tasks per core, and
    the distinct values of the features come to the driver, so features should be whole numbers of a
    limited range.
    """
    found = rows.agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum(F.when(F.col("label"), F.col("n"))).alias("ones")).first()
    if not found["ones"] or found["ones"] == found["n"]:
        return None
    listed = rows.select(F.posexplode("x").alias("feature", "value")).distinct().collect()
    values = [np.array(sorted(r["value"] for r in listed if r["feature"] == j)) for j in range(1 + max(r["feature"] for r in listed))]
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values])))
    share = found["ones"] / found["n"]
    start = float(np.log(share / (1 - share)))
    tasks = min(2 * rows.sparkSession.sparkContext.defaultParallelism, 1 + found["rows"] // BLOCK)
    blocks = rows.select("label", "x", "n").coalesce(tasks).rdd.mapPartitions(_blocks(values)).persist(StorageLevel.MEMORY_AND_DISK)
    grown: list[_Grown] = []
    for _ in range(trees):
        inner = 2**depth - 1
        tree = _Grown(np.zeros(inner, np.int64), np.full(inner, np.iinfo(np.int32).max), np.zeros(2**depth))
        for level in range(depth):
            gradient, hessian = blocks.map(_sums(start, grown, tree, depth, level, offsets)).reduce(np.add) / SCALE
            for k in range(2**level):
                n = 2**level - 1 + k
                tree.feature[n], tree.cut[n], g, h = _best_cut(gradient[k], hessian[k], offsets, ridge)
                if level == depth - 1:
                    whole = gradient[k, : offsets[1]].sum(), hessian[k, : offsets[1]].sum()
                    tree.leaf[2 * k] = rate * g / (h + ridge)
                    tree.leaf[2 * k + 1] = rate * (whole[0] - g) / (whole[1] - h + ridge)
        grown.append(tree)
    blocks.unpersist()

    def threshold(feature: int, cut: int) -> float:
        return float(values[feature][cut : cut + 2].mean()) if cut + 1 < len(values[feature]) else np.inf

    return Trees(
        np.array([t.feature for t in grown]),
        np.array([[threshold(f, c) for f, c in zip(t.feature, t.cut)] for t in grown]),
        np.array([t.leaf for t in grown]),
        start,
    )
