"""Gradient-boosted trees with monotonic constraints, kept as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Nodes of all trees in a row: a leaf has feature -1. roots: where each tree begins."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row; all rows go down a tree together, a level at a time."""
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(f < 0, node, down)
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 5, penalty: float = 1.0) -> Trees:
    """Boosts trees on the logistic loss.

    monotone has a sign for each feature: 1, the score never falls as it grows; -1, never rises; 0, free.
    A split against its sign isn't taken, and the values below a split on a signed feature stay on
    their side of the mean of its two values.
    """
    n, d = x.shape
    mean = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]) if n else np.zeros((0, d), int)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots, margin = [], np.full(n, bias)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + penalty), low, high))
        nodes.append([-1, 0.0, -1, -1, rate * value])
        margin[rows] += rate * value
        if level == depth or len(rows) < 2 * least:
            return at
        best = (1e-6, -1, -1, 0.0, 0.0)
        whole_g, whole_h = g[rows].sum(), h[rows].sum()
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, j]
            size = len(c) + 1
            lg, lh, ln = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
            rg, rh, rn = whole_g - lg, whole_h - lh, len(rows) - ln
            vl, vr = np.clip(-lg / (lh + penalty), low, high), np.clip(-rg / (rh + penalty), low, high)
            # the loss saved by the clipped values
            gain = -(lg * vl + (lh + penalty) * vl**2 / 2) - (rg * vr + (rh + penalty) * vr**2 / 2) + whole_g * value + (whole_h + penalty) * value**2 / 2
            ok = (ln >= least) & (rn >= least) & (monotone[j] * (vr - vl) >= 0)
            gain = np.where(ok, gain, -np.inf)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        _, j, k, vl, vr = best
        if j < 0:
            return at
        margin[rows] -= rate * value
        goes_left = binned[rows, j] <= k
        mid, sign = (vl + vr) / 2, monotone[j]
        left = grow(rows[goes_left], g, h, level + 1, mid if sign < 0 else low, mid if sign > 0 else high)
        right = grow(rows[~goes_left], g, h, level + 1, mid if sign > 0 else low, mid if sign < 0 else high)
        nodes[at] = [j, float(cuts[j][k]), left, right, 0.0]
        return at

    for _ in range(trees if n and y.min() < y.max() else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -np.inf, np.inf))
    flat = np.array(nodes, float).reshape(-1, 5)
    return Trees(np.array(roots, int), flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], bias, depth)
