"""Gradient boosted trees for a two-class target, small enough for a driver.

Logistic loss, features cut into quantile bins, trees of a fixed depth grown
level by level with second-order gains. Used on bounded samples only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A full binary tree as arrays: node i has children 2i + 1 and 2i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = self.feature[at]
            right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[at])
            at = 2 * at + 1 + right
        return self.value[at]


@dataclass
class Boosted:
    base: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -60, 60)))


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3,
    bins: int = 32, l2: float = 1.0, least_weight: float = 1.0,
) -> Boosted:
    """Fit on rows ``x`` with labels ``y`` (0 or 1)."""
    n, d = x.shape
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))), [])
    if n == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    margin = np.full(n, model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        size = 2 ** (depth + 1) - 1
        tree = Tree(np.full(size, -1), np.full(size, np.inf), np.zeros(size), depth)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            best_gain = np.full(many, 1e-6)
            for j in range(d):
                width = len(cuts[j]) + 1
                if width < 2:
                    continue
                slot = (node - first) * width + binned[:, j]
                gs = np.bincount(slot, g, many * width).reshape(many, width)
                hs = np.bincount(slot, h, many * width).reshape(many, width)
                gl, hl = np.cumsum(gs, 1)[:, :-1], np.cumsum(hs, 1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gr, hr = gt - gl, ht - hl
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gt**2 / (ht + l2)
                gain[(hl < least_weight) | (hr < least_weight)] = 0
                top = gain.argmax(1)
                for k in np.nonzero(gain[np.arange(many), top] > best_gain)[0]:
                    best_gain[k] = gain[k, top[k]]
                    tree.feature[first + k], tree.cut[first + k] = j, cuts[j][top[k]]
            f = tree.feature[node]
            right = (f >= 0) & (x[np.arange(n), np.maximum(f, 0)] > tree.cut[node])
            node = 2 * node + 1 + right
        leaf_g, leaf_h = np.bincount(node, g, size), np.bincount(node, h, size)
        tree.value = -rate * leaf_g / (leaf_h + l2)
        margin = margin + tree.value[node]
        model.trees.append(tree)
    return model
