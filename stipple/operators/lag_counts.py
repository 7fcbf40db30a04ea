"""Counts of distances between two sets of values, without pairs."""

from __future__ import annotations

import numpy as np

SEARCHED_VALUES = 1 << 16  # values whose bounds of all bins are searched at once


def distances_in_bins(x, x_n, y, y_n, n_bins: int, upper: float):
    """How many pairs of ``x`` and ``y``, values that stand ``x_n`` and ``y_n`` times, have their distance in each of ``n_bins`` equal bins of [0, upper].

    Each distance is the rounded difference that a comparison of the pair would see: bounds found by a search are moved until differences agree with the edge.
    """
    y, place = np.unique(y, return_inverse=True)
    upto = np.concatenate([[0], np.cumsum(np.bincount(place, y_n, len(y)).astype(np.int64))])
    width = upper / n_bins
    edges = np.append(np.arange(1, n_bins) * width, upper)
    below = np.zeros(n_bins, dtype=np.int64)
    order = np.argsort(x)
    for start in range(0, len(x), SEARCHED_VALUES):
        part = order[start:start + SEARCHED_VALUES]
        v, e = x[part][:, None], edges[None, :]
        closed = np.arange(n_bins)[None, :] == n_bins - 1  # the last bin holds its upper edge
        inside = lambda d: (d < e) | (closed & (d == e))
        at = lambda i: y[np.clip(i, 0, len(y) - 1)]
        low, high = np.searchsorted(y, v - e), np.searchsorted(y, v + e)
        for bound, stays in ((low, lambda i: inside(v - at(i))), (high, lambda i: ~inside(at(i) - v))):
            # ``low`` is the first value inside, ``high`` the first beyond: both are the first place where ``stays`` holds
            while (move := (bound > 0) & stays(bound - 1)).any():
                bound -= move
            while (move := (bound < len(y)) & ~stays(bound)).any():
                bound += move
        below += (x_n[part][:, None] * (upto[high] - upto[low])).sum(axis=0)
    return np.diff(below, prepend=0)
