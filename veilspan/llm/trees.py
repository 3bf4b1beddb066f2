"""Bagged decision trees for two classes, fitted in memory on a bounded sample."""

from __future__ import annotations

import numpy as np

#: Per tree: feature (-1 at a leaf), threshold, left and right child, share of the positive class.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _best_split(x: np.ndarray, y: np.ndarray, features: np.ndarray, least: int) -> tuple[int, float] | None:
    n, total = len(y), y.sum()
    best, gain = None, 1e-9
    parent = total * (n - total) / n
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        left = np.cumsum(y[order])[:-1]
        size = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (size >= least) & (n - size >= least)
        if not ok.any():
            continue
        right = total - left
        impurity = left * (size - left) / size + right * (n - size - right) / (n - size)
        impurity[~ok] = np.inf
        i = int(impurity.argmin())
        if parent - impurity[i] > gain:
            gain, best = parent - impurity[i], (int(f), float((v[i] + v[i + 1]) / 2))
    return best


def _grown(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> Tree:
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        share = float(y[rows].mean())
        nodes.append([-1, 0.0, -1, -1, share])
        if level < depth and 0 < share < 1 and len(rows) >= 2 * least:
            some = rng.choice(x.shape[1], size=max(1, x.shape[1] // 2), replace=False)
            split = _best_split(x[rows], y[rows], some, least)
            if split:
                f, t = split
                goes = x[rows, f] <= t
                left, right = grow(rows[goes], level + 1), grow(rows[~goes], level + 1)
                nodes[at][:4] = [f, t, left, right]
        return at

    grow(np.arange(len(y)), 0)
    a = np.array(nodes)
    return a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32), a[:, 4]


class Bag:
    """Trees on bootstrap samples of the rows; a prediction is the mean of the trees' leaf shares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 6, least: int = 3, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.constant = float(y.mean()) if len(y) else 0.0
        self.trees: list[Tree] = []
        if 0 < self.constant < 1:
            for _ in range(trees):
                rows = rng.integers(0, len(y), len(y))
                self.trees.append(_grown(x[rows], y[rows].astype(float), rng, depth, least))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.constant)
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), dtype=np.int32)
            while True:
                f = feature[at]
                live = f >= 0
                if not live.any():
                    break
                rows = np.flatnonzero(live)
                goes = x[rows, f[rows]] <= threshold[at[rows]]
                at[rows] = np.where(goes, left[at[rows]], right[at[rows]])
            total += share[at]
        return total / len(self.trees)
