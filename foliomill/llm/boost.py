"""A small gradient-boosted tree classifier in numpy, trained on a bounded sample and broadcast."""

from __future__ import annotations

import numpy as np


class Booster:
    """Logistic gradient boosting over quantile bins, level-wise trees of fixed depth. Picklable and deterministic."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        """x (rows x features) without NaN, y of 0 and 1. With one class only the score is constant."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        b, f = self._bin(x), np.full(len(y), self.base)
        width = self.bins + 1
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, np.maximum(q * (1 - q), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, width)
            for level in range(self.depth):
                first, n = (1 << level) - 1, 1 << level
                best = np.full(n, 1e-9)
                for j in range(x.shape[1]):
                    cell = (node - first) * width + b[:, j]
                    gs = np.bincount(cell, g, n * width).reshape(n, width).cumsum(axis=1)
                    hs = np.bincount(cell, h, n * width).reshape(n, width).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(n), k]
                    better = top > best
                    best[better] = top[better]
                    feature[first : first + n][better] = j
                    cut[first : first + n][better] = k[better]
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - ((1 << self.depth) - 1)
            value = self.rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + 1)
            f = f + value[leaf]
            self.model.append((feature, cut, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1."""
        b = self._bin(np.asarray(x, float))
        f = np.full(len(b), self.base)
        rows = np.arange(len(b))
        for feature, cut, value in self.model:
            node = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            f += value[node - ((1 << self.depth) - 1)]
        return f
