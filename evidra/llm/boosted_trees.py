"""Gradient-boosted trees on binned statistics, flattened into numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """All trees in one set of arrays: node k asks feature[k] <= cut[k] and goes to left[k], or else to right[k].

    A leaf has itself as both children. roots: the first node of each tree.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row: every tree of every row goes down one level at a time."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            below = x[rows, self.feature[node]] <= self.cut[node]
            node = np.where(below, self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> BoostedTrees:
    """Logistic loss, exact Newton leaves, histogram splits.

    monotone: for each feature 1 (the score never falls as it grows), -1 (never rises) or 0. A constrained split
    must order its two leaf values so, and its subtrees stay on either side of the middle of them.
    """
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], axis=1) if d else np.zeros((n, 0), int)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    raw = np.full(n, base)
    out: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}
    roots = []

    def leaf(value: float) -> int:
        k = len(out["value"])
        for name, v in (("feature", 0), ("cut", np.inf), ("left", k), ("right", k), ("value", rate * value)):
            out[name].append(v)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)

        def best(rows: np.ndarray, low: float, high: float):
            found = (1e-6, None)
            g, h = grad[rows].sum(), hess[rows].sum()
            for j in range(d):
                if not len(cuts[j]):
                    continue
                m = len(cuts[j]) + 1
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, weights=grad[rows], minlength=m))[:-1]
                hl = np.cumsum(np.bincount(b, weights=hess[rows], minlength=m))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=m))[:-1]
                vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip((g - gl) / (h - hl + ridge), low, high)
                v0 = np.clip(g / (h + ridge), low, high)
                loss = lambda v, gs, hs: gs * v - 0.5 * (hs + ridge) * v * v
                gain = loss(vl, gl, hl) + loss(vr, g - gl, h - hl) - loss(v0, g, h)
                gain[(nl < least) | (len(rows) - nl < least) | (monotone[j] * (vr - vl) < 0)] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > found[0]:
                    found = (gain[k], (j, k, float(vl[k]), float(vr[k])))
            return found[1]

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            split = best(rows, low, high) if level < depth and len(rows) >= 2 * least else None
            if split is None:
                value = float(np.clip(grad[rows].sum() / (hess[rows].sum() + ridge), low, high))
                raw[rows] += rate * value
                return leaf(value)
            j, k, vl, vr = split
            me, mid = leaf(0.0), (vl + vr) / 2
            lo = binned[rows, j] <= k
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(monotone[j])]
            a = grow(rows[lo], level + 1, *bounds[0])
            b = grow(rows[~lo], level + 1, *bounds[1])
            out["feature"][me], out["cut"][me], out["left"][me], out["right"][me] = j, float(cuts[j][k]), a, b
            return me

        roots.append(grow(np.arange(n), 0, -4.0, 4.0))
    return BoostedTrees(np.array(out["feature"], np.int64), np.array(out["cut"]), np.array(out["left"], np.int64), np.array(out["right"], np.int64), np.array(out["value"]), np.array(roots, np.int64), depth, base)
