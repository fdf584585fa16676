"""Counting large values in ranges of an ordered column, for many ranges at once."""

from __future__ import annotations

import numpy as np


def count_above(values: np.ndarray, start: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many of values[start[i]:end[i]] exceed limit[i], for every i.

    The values are split bit by bit of their rank (a wavelet matrix). A range is followed through the levels by two lookups in
    running counts of zeros a level, so the cost is (values + ranges) x log(distinct values) whatever the ranges' lengths.
    """
    known, ranks = np.unique(values, return_inverse=True)
    least = np.searchsorted(known, limit, side="right")  # ranks from here on exceed the limit
    lo, hi = start.astype(np.int64), end.astype(np.int64)
    out = np.zeros(len(lo), np.int64)
    for bit in range(max(1, int(len(known)).bit_length()) - 1, -1, -1):
        one = (ranks >> bit) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        z_lo, z_hi = zeros[lo], zeros[hi]
        up = ((least >> bit) & 1).astype(bool)
        out += np.where(up, 0, (hi - lo) - (z_hi - z_lo))
        lo, hi = np.where(up, zeros[-1] + lo - z_lo, z_lo), np.where(up, zeros[-1] + hi - z_hi, z_hi)
        ranks = np.concatenate([ranks[one == 0], ranks[one == 1]])
    return out + (hi - lo)
