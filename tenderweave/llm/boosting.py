"""Gradient-boosted trees for a yes/no label, in numpy: histograms of binned features, logistic loss."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Trees of fixed depth: each inner node compares one feature with one edge."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0):
        self.count, self.depth, self.rate, self.ridge = trees, depth, rate, ridge
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
        n, f = x.shape
        weight = np.ones(n) if weight is None else weight
        share = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], axis=1)
        g = np.full(n, self.base)
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-g))
            grad, hess = weight * (y - p), weight * p * (1 - p) + 1e-9
            node, feature, edge = np.zeros(n, np.int64), [], []
            for level in range(self.depth):
                width = 1 << level
                gain, best = np.zeros(width), np.zeros((width, 2), np.int64)
                for j in range(f):
                    k = len(edges[j]) + 1
                    if k == 1:
                        continue
                    key = node * k + binned[:, j]
                    gs, hs = (np.bincount(key, v, width * k).reshape(width, k).cumsum(axis=1) for v in (grad, hess))
                    left = gs[:, :-1] ** 2 / (hs[:, :-1] + self.ridge)
                    right = (gs[:, -1:] - gs[:, :-1]) ** 2 / (hs[:, -1:] - hs[:, :-1] + self.ridge)
                    own = left + right - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    at = own.argmax(axis=1)
                    better = own[np.arange(width), at] > gain + 1e-9
                    gain[better] = own[np.arange(width), at][better]
                    best[better] = np.stack([np.full(width, j), at], axis=1)[better]
                feature.append(best[:, 0].copy())
                edge.append(np.array([edges[j][b] if gain[i] > 0 else np.inf for i, (j, b) in enumerate(best)]))
                node = node * 2 + (x[np.arange(n), feature[-1][node]] > edge[-1][node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + self.ridge)
            self.trees.append((feature, edge, value))
            g = g + value[node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        g, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, edge, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for f, e in zip(feature, edge):
                node = node * 2 + (x[rows, f[node]] > e[node])
            g += value[node]
        return g
