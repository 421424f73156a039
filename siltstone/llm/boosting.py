"""Gradient-boosted trees for two classes, small enough to train on the driver and to broadcast."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic-loss boosting with trees of fixed depth over quantile cuts, then Platt scaling on held-out rows."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, cuts: int = 16, least: int = 8):
        self.n_trees, self.depth, self.rate, self.cuts, self.least = trees, depth, rate, cuts, least
        self.trees: list[dict] = []
        self.start, self.scale, self.shift = 0.0, 1.0, 0.0

    def _grow(self, x, g, h, rows, depth) -> dict:
        leaf = {"value": float(-g[rows].sum() / (h[rows].sum() + 1.0)) * self.rate}
        if depth == 0 or len(rows) < 2 * self.least:
            return leaf
        best, split = 1e-6, None
        total_g, total_h = g[rows].sum(), h[rows].sum()
        parent = total_g**2 / (total_h + 1.0)
        for f, edges in enumerate(self.edges):
            value = x[rows, f]
            for cut in edges:
                left = value <= cut
                n = int(left.sum())
                if n < self.least or len(rows) - n < self.least:
                    continue
                gl, hl = g[rows[left]].sum(), h[rows[left]].sum()
                gr, hr = total_g - gl, total_h - hl
                gain = gl**2 / (hl + 1.0) + gr**2 / (hr + 1.0) - parent
                if gain > best:
                    best, split = gain, (f, float(cut))
        if split is None:
            return leaf
        goes = x[rows, split[0]] <= split[1]
        return {
            "feature": split[0],
            "cut": split[1],
            "low": self._grow(x, g, h, rows[goes], depth - 1),
            "high": self._grow(x, g, h, rows[~goes], depth - 1),
        }

    def fit(self, x: np.ndarray, y: np.ndarray, calibrate_every: int = 4) -> Boosted:
        """Every `calibrate_every`-th row is held out for the calibration."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        held = np.arange(len(y)) % calibrate_every == 0
        tx, ty = x[~held], y[~held]
        self.edges = [np.unique(np.quantile(tx[:, f], np.linspace(0, 1, self.cuts + 1)[:-1])) for f in range(tx.shape[1])]
        mean = float(np.clip(ty.mean(), 1e-3, 1 - 1e-3))
        self.start = float(np.log(mean / (1 - mean)))
        raw = np.full(len(ty), self.start)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(tx, p - ty, p * (1 - p), np.arange(len(ty)), self.depth)
            self.trees.append(tree)
            raw += self._apply(tree, tx)
        self.scale, self.shift = platt(self.raw(x[held]), y[held])
        return self

    def _apply(self, tree: dict, x: np.ndarray) -> np.ndarray:
        if "value" in tree:
            return np.full(len(x), tree["value"])
        low = x[:, tree["feature"]] <= tree["cut"]
        out = np.empty(len(x))
        out[low] = self._apply(tree["low"], x[low])
        out[~low] = self._apply(tree["high"], x[~low])
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((self._apply(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x) -> np.ndarray:
        x = np.asarray(x, float).reshape(len(x), -1)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -40, 40)))


def platt(raw: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Scale and shift of a logistic calibration, by Newton steps with a little ridge."""
    a, b = 1.0, 0.0
    # Targets as Platt gives them, so that separable scores stay finite.
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        ga, gb = ((p - goal) * raw).sum() + 1e-3 * (a - 1), (p - goal).sum() + 1e-3 * b
        haa, hab, hbb = (w * raw * raw).sum() + 1e-3, (w * raw).sum(), w.sum() + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 5.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return float(a), float(b)
