"""Small gradient-boosted trees for a bounded training set: logistic loss,
Newton leaves, splits between the quantiles of each feature. A fitted model is a
few kilobytes of arrays, which scores rows of features at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth; node k has the children 2k+1 and 2k+2."""

    feature: np.ndarray  # trees x inner nodes
    split: np.ndarray  # value <= split goes left
    leaf: np.ndarray  # trees x leaves
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        inner = self.feature.shape[1]
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, split, leaf in zip(self.feature, self.split, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > split[node])
            out += leaf[node - inner]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """x: rows x features, y: 0 or 1. With no rows every score is one half."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(1) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1) if n else np.zeros((0, width), np.int64)
    inner, size = (1 << depth) - 1, bins + 1
    share = (y.sum() + 1) / (n + 2)
    model = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 1 << depth)), float(np.log(share / (1 - share))))
    margin = np.full(n, model.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p) + 1e-9
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            best = np.full(many, 1e-6)
            for f in range(width):
                key = (node - first) * size + binned[:, f]
                left_g = np.bincount(key, g, many * size).reshape(many, size).cumsum(axis=1)
                left_h = np.bincount(key, h, many * size).reshape(many, size).cumsum(axis=1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                at = gain[:, : len(edges[f])].argmax(axis=1)
                value = gain[np.arange(many), at]
                for k in np.flatnonzero(value > best):
                    best[k], model.feature[t, first + k], model.split[t, first + k] = value[k], f, edges[f][at[k]]
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t][node]] > model.split[t][node])
        at = node - inner
        model.leaf[t] = -rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + ridge)
        margin = margin + model.leaf[t][at]
    return model
