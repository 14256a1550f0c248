"""Gradient-boosted trees with monotonic constraints, kept as flat numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """All nodes of all trees, one tree after the other.

    feature is -1 at a leaf. A row goes left if its value is at most threshold;
    NaN goes right.
    """

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of each row; all rows step down a tree at once."""
        out = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            while True:
                feature = self.feature[at]
                inner = feature >= 0
                if not inner.any():
                    break
                down = rows[every, np.maximum(feature, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(down, self.left[at], self.right[at]), at)
            out += self.value[at]
        return out

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.score(rows), -40, 40)))


def fit(rows: np.ndarray, labels: np.ndarray, monotone: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, leaf: float = 20.0, ridge: float = 1.0) -> Trees:
    """Boost on log loss; monotone has -1, 0 or 1 for each feature.

    A split of a constrained feature is taken only if its sides' values are in
    order, and the mean of the two bounds all that grows below, so that the score
    is monotone in that feature. leaf is the least number of rows in a leaf.
    With no rows, or one class only, there are no trees.
    """
    count, width = rows.shape if len(rows) else (0, len(monotone))
    share = (labels.sum() + 0.5) / (count + 1.0)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    base = float(np.log(share / (1 - share)))

    def node(value: float) -> int:
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", value)):
            nodes[k].append(v)
        return len(nodes["value"]) - 1

    if count and 0 < labels.sum() < count:
        edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(e, rows[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        score = np.full(count, base)
        for _ in range(trees):
            p = 1.0 / (1.0 + np.exp(-score))
            grad, hess = labels - p, np.maximum(p * (1 - p), 1e-6)

            def grow(at: np.ndarray, low: float, high: float, level: int) -> int:
                g, h = grad[at].sum(), hess[at].sum()
                me = node(rate * float(np.clip(g / (h + ridge), low, high)))
                best = (1e-6, -1, -1, 0.0, 0.0)
                for j in range(width if level < depth and len(at) >= 2 * leaf else 0):
                    size = len(edges[j]) + 1
                    gs, hs, ns = (np.cumsum(np.bincount(binned[at, j], w, size))[:-1] for w in (grad[at], hess[at], np.ones(len(at))))
                    lv, rv = np.clip(gs / (hs + ridge), low, high), np.clip((g - gs) / (h - hs + ridge), low, high)
                    gain = gs * lv - 0.5 * (hs + ridge) * lv**2 + (g - gs) * rv - 0.5 * (h - hs + ridge) * rv**2 - 0.5 * g * g / (h + ridge)
                    gain[(ns < leaf) | (len(at) - ns < leaf)] = -np.inf
                    if monotone[j]:
                        gain[monotone[j] * (rv - lv) < 0] = -np.inf
                    if len(gain) and gain[k := int(gain.argmax())] > best[0]:
                        best = (gain[k], j, k, lv[k], rv[k])
                _, j, k, lv, rv = best
                if j < 0:
                    score[at] += nodes["value"][me]
                    return me
                middle = (lv + rv) / 2
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(int(monotone[j]), ((low, high), (low, high)))
                down = binned[at, j] <= k
                nodes["feature"][me], nodes["threshold"][me] = j, float(edges[j][k])
                nodes["left"][me] = grow(at[down], *bounds[0], level + 1)
                nodes["right"][me] = grow(at[~down], *bounds[1], level + 1)
                return me

            roots.append(grow(np.arange(count), -np.inf, np.inf, 0))
    as_array = {k: np.array(v, np.float64 if k in ("threshold", "value") else np.int64) for k, v in nodes.items()}
    return Trees(base, np.array(roots, np.int64), **as_array)
