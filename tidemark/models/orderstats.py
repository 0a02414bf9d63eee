"""Order statistics of every prefix of a sequence, from a wavelet matrix: bits of ranks, level by level, in time order.

The k-th smallest of the first t values takes one step a level. The middle distances from a point that parts a prefix in
halves come from two sorted sides of which any member is such a query, so they take a binary search of queries. All
prefixes are asked at once; memory is a number for each value and level.
"""

from __future__ import annotations

import numpy as np


class Prefixes:
    def __init__(self, values: np.ndarray):
        """values: finite, in order of time."""
        self.sorted = np.sort(values, kind="stable")
        rank = np.empty(len(values), np.int64)
        rank[np.argsort(values, kind="stable")] = np.arange(len(values))
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros, self.split = [], []
        for level in range(self.bits - 1, -1, -1):
            one = (rank >> level) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]).astype(np.int32))
            self.split.append(int(len(rank) - one.sum()))
            rank = np.concatenate([rank[one == 0], rank[one == 1]])

    def smallest(self, t: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the first t values; k < t."""
        low, high, k, rank = np.zeros_like(t), t.copy(), k.copy(), np.zeros_like(t)
        for zeros, split in zip(self.zeros, self.split, strict=True):
            a, b = zeros[low], zeros[high]
            inside = b - a
            up = k >= inside
            k = np.where(up, k - inside, k)
            rank = rank * 2 + up
            low, high = np.where(up, split + low - a, a), np.where(up, split + high - b, b)
        return self.sorted[rank]

    def medians(self, t: np.ndarray) -> np.ndarray:
        a, b = self.smallest(t, (t - 1) // 2), self.smallest(t, t // 2)
        return a + (b - a) * 0.5

    def deviations(self, t: np.ndarray, median: np.ndarray) -> np.ndarray:
        """Median distance of the first t values from their median."""
        below = (t + 1) // 2  # so many are at most the median, the others at least
        a, b = (self._distance(t, below, t - below, median, k) for k in ((t - 1) // 2, t // 2))
        return (a + b) / 2

    def _distance(self, t: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, m: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the distances to the left and to the right, each ascending from the middle."""
        left = lambda i: m - self.smallest(t, np.clip(n_left - 1 - i, 0, t - 1))
        right = lambda j: self.smallest(t, np.clip(n_left + j, 0, t - 1)) - m
        low, high = np.maximum(0, k + 1 - n_right), np.minimum(k + 1, n_left)
        while (low < high).any():
            i = (low + high) // 2
            more = right(k - i) > left(i)
            open_ = low < high
            low, high = np.where(open_ & more, i + 1, low), np.where(open_ & ~more, i, high)
        of_left = np.where(low > 0, left(low - 1), -np.inf)
        of_right = np.where(k + 1 - low > 0, right(k - low), -np.inf)
        return np.maximum(of_left, of_right)


def expanding_median_mad(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and median absolute deviation of each row's prefix, its own value included; NaN counts as no value."""
    known = ~np.isnan(x)
    t = np.cumsum(known)
    med, mad = np.full(len(x), np.nan), np.full(len(x), np.nan)
    some = t > 0
    if some.any():
        p = Prefixes(x[known])
        at = t[some].astype(np.int64)
        med[some] = p.medians(at)
        mad[some] = p.deviations(at, med[some])
    return med, mad
