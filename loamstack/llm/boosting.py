"""Gradient-boosted regression trees with logistic loss, on binned features; small enough to train on the driver."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited trees over at most 32 bins a feature. Training is deterministic; equal gains go to the first feature."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, leaf: int = 8, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.leaf, self.l2 = rounds, depth, rate, leaf, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        values = [np.unique(x[:, j]) for j in range(x.shape[1])]  # where there are few, each has its bin, however rare
        self.edges = [v if len(v) <= 32 else np.unique(np.quantile(x[:, j], np.linspace(0, 1, 32))) for j, v in enumerate(values)]
        b = self._binned(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.base)
        self.trees: list[list[tuple]] = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree: list[tuple] = []
            f += self._grow(b, p - y, p * (1 - p), np.arange(len(y)), 0, tree)
            self.trees.append(tree)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def _grow(self, b, g, h, rows, depth, tree) -> np.ndarray:
        """Appends nodes (feature, bin, left, right, value) in preorder; returns what the subtree adds to each row."""
        me, out = len(tree), np.zeros(len(g))
        value = -self.rate * g[rows].sum() / (h[rows].sum() + self.l2)
        tree.append((-1, 0, 0, 0, float(value)))
        best = (1e-6, -1, 0)
        if depth < self.depth and len(rows) >= 2 * self.leaf:
            sg, sh = g[rows].sum(), h[rows].sum()
            for j in range(b.shape[1]):
                n = len(self.edges[j]) + 1
                cg, ch, cn = (np.cumsum(np.bincount(b[rows, j], w, n))[:-1] for w in (g[rows], h[rows], None))
                gain = cg**2 / (ch + self.l2) + (sg - cg) ** 2 / (sh - ch + self.l2) - sg**2 / (sh + self.l2)
                gain[(cn < self.leaf) | (len(rows) - cn < self.leaf)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
        if best[1] < 0:
            out[rows] = value
            return out
        low = b[rows, best[1]] <= best[2]
        left = len(tree)
        out += self._grow(b, g, h, rows[low], depth + 1, tree)
        right = len(tree)
        out += self._grow(b, g, h, rows[~low], depth + 1, tree)
        tree[me] = (best[1], best[2], left, right, 0.0)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities."""
        if not len(x):
            return np.empty(0)
        b, f = self._binned(x), np.full(len(x), self.base)
        for tree in self.trees:
            feature, cut, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = feature[at]
                go = np.where(b[np.arange(len(x)), np.maximum(j, 0)] <= cut[at], left[at], right[at])
                at = np.where(j < 0, at, go)
            f += value[at]
        return 1 / (1 + np.exp(-f))
