"""Gradient-boosted regression trees on the logistic loss, for small tables of features, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary classifier. Trees split at quantile bins of each feature and are grown depth by depth."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[list[tuple[int, float]]] = []
        self.leaves: list[np.ndarray] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.asarray(x, float), np.asarray(y, float)
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            node, splits = np.zeros(len(y), int), []
            for level in range(self.depth):
                for n in range(1 << level):
                    splits.append(self._split(binned, edges, gradient, weight, node == n))
                offset = (1 << level) - 1
                feature = np.array([s[0] for s in splits[offset:]])[node]
                cut = np.array([s[1] for s in splits[offset:]])[node]
                node = node * 2 + (x[np.arange(len(y)), feature] > cut)
            n_leaves = 1 << self.depth
            leaf = np.bincount(node, gradient, n_leaves) / (np.bincount(node, weight, n_leaves) + 1.0)
            self.trees.append(splits)
            self.leaves.append(leaf)
            score = score + self.rate * leaf[node]
        return self

    def _split(self, binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, inside: np.ndarray) -> tuple[int, float]:
        best, chosen = 1e-9, (0, np.inf)
        g, h = gradient[inside], weight[inside]
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[inside, f]
            left_g, left_h, left_n = (np.cumsum(np.bincount(b, v, len(e) + 1))[:-1] for v in (g, h, np.ones(len(b))))
            gain = left_g**2 / (left_h + 1.0) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1.0) - whole
            gain[(left_n < self.least) | (len(b) - left_n < self.least)] = 0
            if len(gain) and gain.max() > best:
                best, chosen = float(gain.max()), (f, float(e[int(gain.argmax())]))
        return chosen

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for splits, leaf in zip(self.trees, self.leaves):
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                offset = (1 << level) - 1
                feature = np.array([s[0] for s in splits[offset : offset + (1 << level)]])[node]
                cut = np.array([s[1] for s in splits[offset : offset + (1 << level)]])[node]
                node = node * 2 + (x[rows, feature] > cut)
            score += self.rate * leaf[node]
        return 1 / (1 + np.exp(-score))
