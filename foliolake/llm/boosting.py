"""Gradient-boosted trees for a binary label, in numpy, for bounded training tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Each tree is a list of (feature, threshold) by level-order node and leaf values;
    rows with value > threshold go right."""

    base: float = 0.0
    depth: int = 3
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    scale: tuple[float, float] = (1.0, 0.0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32) -> Boosted:
    """Newton boosting on the logistic loss over quantile bins."""
    p = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    made = Boosted(float(np.log(p / (1 - p))), depth)
    if len(np.unique(y)) < 2:
        return made
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    f = np.full(len(y), made.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-f))
        g, h = y - q, q * (1 - q) + 1e-6
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for n in range(inner):
            rows = np.flatnonzero(node == n)
            best = 1e-6
            if len(rows) >= 10:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for j, c in enumerate(cuts):
                    if len(c):
                        left_g = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                        left_h = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                        gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                        k = int(gain.argmax())
                        if gain[k] > best:
                            best, feature[n], threshold[n] = gain[k], j, c[k]
            node[rows] = 2 * n + 1 + (x[rows, feature[n]] > threshold[n])
        at = node - inner
        leaf = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + 1)
        made.trees.append((feature, threshold, leaf))
        f += leaf[at]
    return made


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Platt scaling on rows that the trees didn't see, then the lowest probability
    from which on at least `precision` of these rows are positive (above 1: none)."""
    if not len(y) or len(np.unique(y)) < 2:
        return 1.1
    r = model.raw(x)
    a, b, t = 1.0, 0.0, (y * (y.sum() + 1) / (y.sum() + 2) + (1 - y) / ((1 - y).sum() + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * r + b, -40, 40)))
        w, d = p * (1 - p) + 1e-9, p - t
        grad = np.array([(d * r).sum(), d.sum()])
        hess = np.array([[(w * r * r).sum(), (w * r).sum()], [(w * r).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    model.scale = (float(a), float(b))
    p = model.probability(x)
    order = np.argsort(-p, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((share >= precision) & (np.append(p[order][1:], -1) < p[order]))
    return float(p[order][good[-1]]) if len(good) else 1.1
