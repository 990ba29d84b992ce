"""Decision trees and random forests over small labelled tables, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Node i goes left (node ``left[i]``) where ``x[feature[i]] <= cut[i]``; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.value[at]
            n = at[inner]
            at[inner] = np.where(x[inner, self.feature[n]] <= self.cut[n], self.left[n], self.right[n])


def _best_cut(x: np.ndarray, y: np.ndarray, features: np.ndarray, leaf: int) -> tuple[int, float] | None:
    """Feature and value of the cut with the least Gini impurity; ties: the first."""
    best, found = np.inf, None
    n = len(y)
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        k = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (k >= leaf) & (n - k >= leaf)
        if not ok.any():
            continue
        a, b = ones[:-1] / k, (ones[-1] - ones[:-1]) / (n - k)
        impurity = np.where(ok, k * a * (1 - a) + (n - k) * b * (1 - b), np.inf)
        i = int(np.argmin(impurity))
        if impurity[i] < best - 1e-12:
            best, found = impurity[i], (int(f), float((v[i] + v[i + 1]) / 2))
    return found


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, leaf: int = 1, tried: int | None = None, rng: np.random.Generator | None = None) -> Tree:
    """A CART tree of at most ``depth`` levels; with ``tried``, each node looks at so many random features."""
    nodes: list[list[float]] = []

    def build(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(y[rows].mean()) if len(rows) else 0.5])
        if level == depth or len(rows) < 2 * leaf or y[rows].min() == y[rows].max():
            return me
        features = np.arange(x.shape[1]) if tried is None else rng.permutation(x.shape[1])[:tried]
        if (cut := _best_cut(x[rows], y[rows], features, leaf)) is None:
            return me
        goes = x[rows, cut[0]] <= cut[1]
        nodes[me][:2] = cut
        nodes[me][2] = build(rows[goes], level + 1)
        nodes[me][3] = build(rows[~goes], level + 1)
        return me

    build(np.arange(len(y)), 0)
    cols = list(zip(*nodes))
    return Tree(*(np.array(c, dtype=t) for c, t in zip(cols, (np.int64, np.float64, np.int64, np.int64, np.float64))))


@dataclass
class Forest:
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0)


def plant(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, seed: int = 7) -> Forest:
    """A forest of trees on bootstrap rows, each node choosing among sqrt(features) of them."""
    rng = np.random.default_rng(seed)
    tried = max(1, int(np.ceil(np.sqrt(x.shape[1]))))
    grown = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        grown.append(grow(x[rows], y[rows], depth, 1, tried, rng))
    return Forest(grown)
