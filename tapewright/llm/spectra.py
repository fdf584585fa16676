"""Eigendecompositions kept up to date by symmetric rank-one updates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(origin, tau): the roots d[origin] + tau of 1 + sum(z2 / (d - x)) = 0, for ascending distinct d and positive z2.

    Each root lies between two poles and is found as a distance from the nearer one, all roots at once: a model with the
    two poles next to it (the middle way) gives the next point, halving the bracket where that fails.
    """
    k = len(d)
    at = np.arange(k)
    width = np.append(d[1:], d[-1] + z2.sum()) - d
    middle = (z2 / (d[None, :] - (d + width / 2)[:, None])).sum(1) + 1
    # The last root's upper end is no pole, so its distance is always from below.
    origin = np.where((middle >= 0) | (at == k - 1), at, at + 1)
    delta = d[None, :] - d[origin][:, None]
    lo = np.where(origin == at, np.where(middle >= 0, 0.0, width / 2), -width / 2)
    hi = np.where(origin == at, np.where(middle >= 0, width / 2, width), 0.0)
    below = at[None, :] <= at[:, None]
    poles = np.append(d, d[-1] + z2.sum())
    left, right = d - d[origin], poles[at + 1] - d[origin]
    tau = (lo + hi) / 2
    open_ = np.ones(k, bool)
    for _ in range(120):
        gap = delta - tau[:, None]
        gap[gap == 0] = np.finfo(float).tiny
        part = z2 / gap
        f = 1 + part.sum(1)
        slope = part / gap
        # The function grows from pole to pole.
        lo, hi = np.where(open_ & (f < 0), tau, lo), np.where(open_ & (f >= 0), tau, hi)
        open_ &= (np.abs(f) > 4 * EPS * k * (1 + np.abs(part).sum(1))) & (hi - lo > 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
        if not open_.any():
            break
        dl, dr = left - tau, right - tau
        psi, phi = np.where(below, slope, 0).sum(1), np.where(below, 0, slope).sum(1)
        a = (dl + dr) * f - dl * dr * (psi + phi)
        b = dl * dr * f
        c = f - dl * psi - dr * phi
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = tau + step
        good = np.isfinite(new) & (new > lo) & (new < hi)
        tau = np.where(open_, np.where(good, new, (lo + hi) / 2), tau)
    return origin, tau


def rank_one(values: np.ndarray, vectors: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of vectors @ diag(values) @ vectors.T + z z'.

    Deflation: entries of the rotated z that are negligible leave their pair as it is, and of equal eigenvalues all but
    one are rotated out of z. The rest comes from the secular equation; z is recomputed from the roots, so that the new vectors
    stay orthogonal to working precision.
    """
    w = vectors.T @ z
    scale = max(np.abs(values).max(initial=0.0), w @ w)
    if scale == 0:
        return values, vectors
    order = np.argsort(values, kind="stable")
    values, vectors, w = values[order].copy(), vectors[:, order], w[order]
    tol = 8 * EPS * scale
    live = np.abs(w) * np.sqrt(scale) > tol
    vectors = vectors.copy()
    last = -1
    for i in np.flatnonzero(live):
        if last >= 0 and values[i] - values[last] <= tol:
            r = np.hypot(w[last], w[i])
            c, s = w[i] / r, w[last] / r
            vectors[:, [last, i]] = vectors[:, [last, i]] @ np.array([[c, s], [-s, c]])
            w[last], w[i] = 0.0, r
            live[last] = False
        last = i
    k = np.flatnonzero(live)
    if not len(k):
        return values, vectors
    d = values[k]
    origin, tau = secular_roots(d, w[k] ** 2)
    # d_j - root_i, each to full relative precision
    gaps = (d[None, :] - d[origin][:, None]) - tau[:, None]
    new = d[origin] + tau
    # Loewner's formula: the z for which these roots are exact.
    ratio = -gaps.T.copy()  # [j, i] = root_i - d_j
    over = d[None, :] - d[:, None]  # [j, i] = d_i - d_j
    np.fill_diagonal(over, 1.0)
    zz = np.sqrt(np.abs(np.prod(ratio / over, axis=1))) * np.where(w[k] < 0, -1, 1)
    q = zz[None, :] / gaps
    q /= np.linalg.norm(q, axis=1)[:, None]
    values[k] = new
    vectors[:, k] = vectors[:, k] @ q.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Number of rows, their mean, and the eigenvalues and eigenvectors of their scatter about the mean."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, rows: np.ndarray) -> None:
        """Take in a block of rows: centred, condensed by an orthogonal reduction to at most as many rows as columns
        (which leaves their scatter as it is), and each of those a rank-one update."""
        mean = rows.mean(0)
        centred = rows - mean
        if len(centred) > centred.shape[1]:
            centred = np.linalg.qr(centred, mode="r")
        self._join(len(rows), mean, centred)

    def merge(self, other: Spectrum) -> None:
        """Take in the other spectrum: a rank-one update for each of its eigenpairs."""
        self._join(other.n, other.mean, np.sqrt(np.maximum(other.values, 0))[:, None] * other.vectors.T)

    def _join(self, n: int, mean: np.ndarray, updates: np.ndarray) -> None:
        if not n:
            return
        for z in updates:
            self.values, self.vectors = rank_one(self.values, self.vectors, z)
        if self.n:
            apart = np.sqrt(self.n * n / (self.n + n)) * (mean - self.mean)
            self.values, self.vectors = rank_one(self.values, self.vectors, apart)
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n
