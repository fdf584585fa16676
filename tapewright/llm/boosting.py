"""A small gradient-boosted classifier for one driver-side fit on weighted rows of a bounded number of forms."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of trees of fixed depth over at most `bins` cuts a feature; calibrated by a logistic curve. A row counts as often as its weight says."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 16):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list = []
        self.start, self.slope, self.shift = 0.0, 1.0, 0.0

    def _cuts(self, c, w):
        order = np.argsort(c, kind="stable")
        below = np.cumsum(w[order])
        at = np.searchsorted(below, np.linspace(0, 1, self.bins + 1)[1:-1] * below[-1])
        return np.unique(c[order][np.minimum(at, len(c) - 1)])

    def fit(self, x, y, w) -> BoostedTrees:
        self.start = float(np.log(((w * y).sum() + 1) / ((w * (1 - y)).sum() + 1)))
        cuts = [self._cuts(c, w) for c in x.T]
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, w * (y - p), w * p * (1 - p), np.arange(len(y)), cuts, self.depth)
            self.trees.append(tree)
            f = f + self.rate * self._walk(tree, x)
        return self

    def _grow(self, x, g, h, rows, cuts, depth):
        value = float(g[rows].sum() / (h[rows].sum() + 1.0))
        best = (1e-6, None)
        if depth:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
            for j, edges in enumerate(cuts):
                if not len(edges):
                    continue
                b = np.searchsorted(edges, x[rows, j])
                gs, hs = (np.cumsum(np.bincount(b, weights=w[rows], minlength=len(edges) + 1)) for w in (g, h))
                gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - whole
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, float(edges[k])))
        if best[1] is None:
            return value
        j, cut = best[1]
        left = x[rows, j] <= cut
        return (j, cut, self._grow(x, g, h, rows[left], cuts, depth - 1), self._grow(x, g, h, rows[~left], cuts, depth - 1))

    def _walk(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, a, b = tree
        return np.where(x[:, j] <= cut, self._walk(a, x), self._walk(b, x))

    def raw(self, x):
        return self.start + self.rate * sum(self._walk(t, x) for t in self.trees)

    def calibrate(self, x, y, w) -> BoostedTrees:
        """Logistic curve through the raw scores of held-out rows, by gradient steps."""
        f, w = np.clip(self.raw(x), -20, 20), w / w.sum()
        a, b = 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-(a * f + b)))
            a, b = a + 0.02 * float((w * (y - p) * f).sum()), b + 0.2 * float((w * (y - p)).sum())
        self.slope, self.shift = a, b
        return self

    def probability(self, x):
        return 1 / (1 + np.exp(-(self.slope * np.clip(self.raw(x), -20, 20) + self.shift)))
