"""Gradient-boosted trees for two classes on a bounded sample: histograms of binned features, Newton leaves."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Additive trees of equal depth; a node's children lie at 2i + 1 and 2i + 2."""

    def __init__(self, trees: int = 30, depth: int = 4, rate: float = 0.3, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.ridge = trees, depth, rate, ridge
        self.start = 0.0
        self.cuts: list[np.ndarray] = []
        self.features = np.zeros((0, 2**depth - 1), int)
        self.thresholds = np.zeros((0, 2**depth - 1))
        self.leaves = np.zeros((0, 2**depth))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """``x`` is rows by features, ``y`` 0 or 1. The same rows give the same model."""
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(n, self.start)
        inner = 2**self.depth - 1
        features, thresholds, leaves = [], [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            slope, bend = y - p, p * (1 - p)
            at = np.zeros(n, int)
            feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                best = np.full(count, 1e-6)
                for f in range(width):
                    cell = (at - first) * BINS + binned[:, f]
                    g = np.bincount(cell, slope, count * BINS).reshape(count, BINS).cumsum(1)
                    h = np.bincount(cell, bend, count * BINS).reshape(count, BINS).cumsum(1)
                    whole = g[:, -1:] ** 2 / (h[:, -1:] + self.ridge)
                    right_g, right_h = g[:, -1:] - g, h[:, -1:] - h
                    gain = g**2 / (h + self.ridge) + right_g**2 / (right_h + self.ridge) - whole
                    gain = gain[:, : len(cuts[f])]
                    if not gain.shape[1]:
                        continue
                    cut = gain.argmax(1)
                    top = gain[np.arange(count), cut]
                    better = top > best
                    best = np.where(better, top, best)
                    where = first + np.flatnonzero(better)
                    feature[where], threshold[where] = f, cuts[f][cut[better]]
                at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
            leaf = at - inner
            g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, bend, inner + 1)
            value = self.rate * g / (h + self.ridge)
            score = score + value[leaf]
            features.append(feature)
            thresholds.append(threshold)
            leaves.append(value)
        self.features, self.thresholds, self.leaves = np.stack(features), np.stack(thresholds), np.stack(leaves)
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for each row."""
        rows = np.arange(len(x))
        out = np.full(len(x), self.start)
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - len(feature)]
        return out
