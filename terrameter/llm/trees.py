"""Small decision trees in numpy, grown on bounded labelled samples.

Shared by the forest that scores secret candidates and by the rules of the quality classifier.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays; ``feature`` is -1 at a leaf, and rows with x <= cut go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray  # of label 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.share[at]
            f = np.maximum(self.feature[at], 0)
            step = np.where(x[rows, f] <= self.cut[at], self.left[at], self.right[at])
            at = np.where(inner, step, at)

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """Every path from the root to a node below it, as (feature, is greater, cut) conditions."""
        out, todo = [], [(0, ())]
        while todo:
            i, path = todo.pop()
            if path:
                out.append(path)
            if (f := int(self.feature[i])) >= 0:
                todo.append((int(self.left[i]), (*path, (f, False, float(self.cut[i])))))
                todo.append((int(self.right[i]), (*path, (f, True, float(self.cut[i])))))
        return out


def cuts_of(x: np.ndarray, most: int = 32) -> list[np.ndarray]:
    """Candidate cuts of each feature: midpoints of neighbouring quantiles."""
    out = []
    for column in x.T:
        seen = np.unique(np.quantile(column, np.linspace(0, 1, most + 1), method="nearest"))
        out.append((seen[1:] + seen[:-1]) / 2)
    return out


def grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator, depth: int, tries: int, least: int = 5) -> Tree:
    """One tree on a bootstrap sample; each node looks at ``tries`` random features (Gini impurity)."""
    feature, cut, left, right, share = [], [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        i = len(feature)
        p = float(y[rows].mean())
        for column, value in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (share, p)):
            column.append(value)
        if level == depth or len(rows) < 2 * least or p in (0.0, 1.0):
            return i
        best, n, ones = (p * (1 - p) * len(rows) - 1e-9, -1, 0.0), len(rows), y[rows].sum()
        for f in rng.permutation(x.shape[1])[:tries]:
            if not len(cuts[f]):
                continue
            at = np.searchsorted(cuts[f], x[rows, f], side="left")  # x <= cut k for all k >= at
            low = np.cumsum(np.bincount(at, minlength=len(cuts[f]) + 1))[:-1]
            low_ones = np.cumsum(np.bincount(at, weights=y[rows], minlength=len(cuts[f]) + 1))[:-1]
            high, high_ones = n - low, ones - low_ones
            ok = (low >= least) & (high >= least)
            if ok.any():
                cost = np.full(len(low), np.inf)
                cost[ok] = low_ones[ok] * (1 - low_ones[ok] / low[ok]) + high_ones[ok] * (1 - high_ones[ok] / high[ok])
                k = int(cost.argmin())
                if cost[k] < best[0]:
                    best = float(cost[k]), int(f), float(cuts[f][k])
        if best[1] >= 0:
            goes = x[rows, best[1]] <= best[2]
            feature[i], cut[i] = best[1], best[2]
            left[i] = node(rows[goes], level + 1)
            right[i] = node(rows[~goes], level + 1)
        return i

    node(rng.integers(0, len(x), len(x)), 0)
    return Tree(*(np.array(c) for c in (feature, cut, left, right, share)))


def forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int, tries: int | None = None) -> list[Tree]:
    rng = np.random.default_rng(seed)
    tries = tries or max(1, round(np.sqrt(x.shape[1])) + 1)
    cuts = cuts_of(x)
    return [grow(x, y.astype(float), cuts, rng, depth, tries) for _ in range(trees)]
