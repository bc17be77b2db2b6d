"""Histogram gradient-boosted trees in numpy, flattened into arrays for traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All nodes of all trees in one set of arrays; a leaf has itself as both children."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        raw = np.full(len(x), self.base)
        if len(self.roots) and len(x):
            at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            raw += self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.15, bins: int = 128,
        ridge: float = 1.0, least: float = 3.0) -> Forest:
    """Boost the logistic loss. Features are binned once at their quantiles; each level of a tree
    sums gradients by (node, feature, bin) in one pass and splits every node at its best bin.

    Without rows, or with one label only, the forest is empty and gives the smoothed share of label 1.
    """
    n, share = len(y), (float(np.sum(y)) + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    empty = np.zeros(0, dtype=np.int64)
    if n == 0 or np.min(y) == np.max(y):
        return Forest(empty, empty, np.zeros(0), empty, empty, np.zeros(0), base, depth)
    f = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(f)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(f)], axis=1)
    offset = np.arange(f) * bins
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        for array, start in ((feature, 0), (threshold, np.inf), (left, k), (right, k), (value, 0.0)):
            array.append(start)
        return k

    raw = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        at, local = [root], np.zeros(n, dtype=np.int64)
        for level in range(depth + 1):
            k = len(at)
            live = local >= 0
            sums = [np.bincount(local[live], weights=v[live], minlength=k) for v in (g, h)]
            for i, own in enumerate(at):
                value[own] = -rate * sums[0][i] / (sums[1][i] + ridge)
            if level == depth:
                break
            slot = (local[live, None] * (f * bins) + offset + code[live]).ravel()
            hist = [np.bincount(slot, weights=np.repeat(v[live], f), minlength=k * f * bins).reshape(k, f, bins).cumsum(axis=2) for v in (g, h)]
            gl, hl = hist
            gr, hr = sums[0][:, None, None] - gl, sums[1][:, None, None] - hl
            gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge), -np.inf)
            gain -= (sums[0] ** 2 / (sums[1] + ridge))[:, None, None]
            best = gain.reshape(k, -1).argmax(axis=1)
            top = gain.reshape(k, -1).max(axis=1)
            moved, fresh = np.full(n, -1, dtype=np.int64), []
            for i, own in enumerate(at):
                j, b = divmod(int(best[i]), bins)
                if not np.isfinite(top[i]) or top[i] <= 1e-9 or b >= len(cuts[j]):
                    continue
                feature[own], threshold[own] = j, float(cuts[j][b])
                left[own], right[own] = node(), node()
                rows = np.flatnonzero(local == i)
                low = code[rows, j] <= b
                moved[rows[low]], moved[rows[~low]] = len(fresh), len(fresh) + 1
                fresh += [left[own], right[own]]
            if not fresh:
                break
            at, local = fresh, moved
        tree = Forest(np.array([root]), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), 0.0, depth)
        at_leaf = np.full(n, root)
        rows = np.arange(n)
        for _ in range(depth):
            at_leaf = np.where(x[rows, tree.feature[at_leaf]] <= tree.threshold[at_leaf], tree.left[at_leaf], tree.right[at_leaf])
        raw += tree.value[at_leaf]
    return Forest(np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), base, depth)
