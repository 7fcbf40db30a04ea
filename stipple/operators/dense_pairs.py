"""Pair histograms of one tile by numpy, for frames too dense to make a row of each pair.

Spark partitions the points by tile and adds up the parts; a call here sees the two sides of one tile, which
``pairs.tiled_sides`` keeps small. Distances and bins are those of ``columns.bin_index``, to the last bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 15  # distances made at once
SLICE = 1 << 16  # the same where they are halves of a double
LABELS = 1 << 20  # bins of one byte counted at once
FEW = 1 << 14  # pairs that are not worth a table
HALF = 512  # points of one side that are not halved further
CLASS_PAIRS = 1 << 12  # pairs that two classes need on average to be worth calls of their own
FINE = 1 << 13  # cells of the squared distance
CROWD = 32  # points in three neighbouring cells of a column beyond which the column is compared point by point
EXACT = 1 << 52  # whole numbers that a double adds up without loss


def bins_of(d: np.ndarray, n_bins: int, upper: float) -> np.ndarray:
    """``columns.bin_index`` of distances; ``n_bins`` beyond ``upper``."""
    width = upper / n_bins
    g = np.minimum(d / width, n_bins - 1).astype(np.int64)
    g -= d < g * width
    g += (g < n_bins - 1) & (d >= (g + 1) * width)
    return np.where(d <= upper, g, n_bins)


def by_pair(a, b, n_bins: int, upper: float) -> np.ndarray:
    """``by_point`` of few points, without its tables."""
    dx, dy = a[0][:, None] - b[0], a[1][:, None] - b[1]
    at = bins_of(np.sqrt(dx * dx + dy * dy), n_bins, upper) + (a[3][:, None] * 2 + b[3]) * (n_bins + 1)
    w = np.multiply.outer(a[2].astype(float), b[2])
    return np.bincount(at.ravel(), w.ravel(), 4 * (n_bins + 1)).reshape(2, 2, n_bins + 1)[:, :, :n_bins]


def by_point(a, b, n_bins: int, upper: float) -> np.ndarray:
    """Every point against every point: counts (group of a, group of b, bin).

    Squared distances are counted in fine cells that lie in one bin each; those near an edge are looked at again.
    """
    scale, out = FINE / (upper * upper), np.zeros((2, 2, n_bins + 1))
    limits = np.sqrt(np.arange(FINE + 2) / scale)
    cell = np.minimum(bins_of(limits[:-1] * (1 - 1e-9), n_bins, upper), n_bins)
    unsure = cell != bins_of(limits[1:] * (1 + 1e-9), n_bins, upper)
    for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
        (xa, ya, wa), (xb, yb, wb) = ([v[side[3] == g] for v in side[:3]] for side, g in ((a, i), (b, j)))
        if not len(xa) or not len(xb):
            continue
        plain, fine = wa.max() == 1 and wb.max() == 1, np.zeros(FINE + 1)
        step = max(1, BLOCK // len(xb))
        for k in range(0, len(xa), step):
            dx, dy = xa[k:k + step, None] - xb, ya[k:k + step, None] - yb
            dx *= dx
            dy *= dy
            dx += dy
            np.multiply(dx, scale, out=dy)
            at = np.minimum(dy, FINE, out=dy).astype(np.intp).ravel()
            w = None if plain else (wa[k:k + step, None] * wb).ravel()
            fine += np.bincount(at, w, FINE + 1)
            again = np.flatnonzero(unsure.take(at))
            w = np.ones(len(again)) if plain else w[again]
            fine -= np.bincount(at[again], w, FINE + 1)
            out[i, j] += np.bincount(bins_of(np.sqrt(dx.ravel()[again]), n_bins, upper), w, n_bins + 1)
        out[i, j] += np.bincount(cell, fine, n_bins + 1)
    return out[:, :, :n_bins]


def counted(labels: np.ndarray, n_bins: int) -> np.ndarray:
    """How often each bin stands among the bytes, which are of even number."""
    if len(labels) < LABELS >> 3:
        return np.bincount(labels, minlength=256)[:n_bins]
    two = np.bincount(labels.view(np.uint16), minlength=1 << 16).reshape(256, 256)  # two bytes are one number
    return (two.sum(0) + two.sum(1))[:n_bins]


def plain(xa, ya, xb, yb, n_bins: int, upper: float) -> np.ndarray:
    """Every point of weight one against every point: counts by bin.

    Distances in units of a bin are made in single precision; those near a whole number are made again in double.
    """
    scale, n = n_bins / upper, len(xb)
    u, p = (((s - xb[0]) * scale).astype(np.float32) for s in (xa, xb))
    v, q = (((s - yb[0]) * scale).astype(np.float32) for s in (ya, yb))
    extent = max(np.abs(s).max() for s in (u, v, p, q))
    margin, far = np.float32(max(1e-4, 1e-6 * extent)), 3 * extent >= 254
    step = max(1, SLICE // n)
    rows = max(step, LABELS // n)
    d, near = np.empty((2, min(step, len(xa)), n), dtype=np.float32)
    unsure = np.zeros((d.size + 7) // 8 * 8, dtype=bool)
    labels = np.empty(min(rows, len(xa)) * n + 1, dtype=np.uint8)
    out = np.zeros(n_bins + 1, dtype=np.int64)
    for first in range(0, len(xa), rows):
        end = min(first + rows, len(xa))
        for k in range(first, end, step):
            m = min(step, end - k)
            dk, nk, uk = d[:m], near[:m], unsure[:m * n]
            lk = labels[(k - first) * n:(k - first + m) * n]
            np.subtract(u[k:k + m, None], p, out=dk)
            np.subtract(v[k:k + m, None], q, out=nk)
            dk *= dk
            nk *= nk
            dk += nk
            np.sqrt(dk, out=dk)
            if far:  # beyond the last bin, whatever a byte holds
                np.minimum(dk, np.float32(254.5), out=dk)
            np.copyto(lk, dk.ravel(), casting="unsafe")
            np.rint(dk, out=nk)
            nk -= dk
            np.abs(nk, out=nk)
            np.less(nk.ravel(), margin, out=uk)
            unsure[m * n:] = False
            again = np.flatnonzero(unsure.view(np.uint64))
            if len(again):
                again = (again[:, None] * 8 + np.arange(8)).ravel()
                again = again[unsure[again]]
                lk[again] = 255
                r, c = np.divmod(again, n)
                dx, dy = xa[r + k] - xb[c], ya[r + k] - yb[c]
                out += np.bincount(bins_of(np.sqrt(dx * dx + dy * dy), n_bins, upper), minlength=n_bins + 1)
        size = (end - first) * n
        if size % 2:
            labels[size] = 255
        out[:n_bins] += counted(labels[:size + size % 2], n_bins)
    return out[:n_bins]


def plain_same(x, y, n_bins: int, upper: float) -> np.ndarray:
    """``plain`` of one side with itself; a pair of its halves is looked at once and counts twice."""
    n = len(x)
    if n <= HALF:
        return plain(x, y, x, y, n_bins, upper)
    h = n // 2
    return 2 * plain(x[:h], y[:h], x[h:], y[h:], n_bins, upper) + plain_same(x[:h], y[:h], n_bins, upper) + plain_same(x[h:], y[h:], n_bins, upper)


def classes(side) -> list:
    """The points of each group and weight: (x, y, weight, group)."""
    kind = side[2] * 2 + side[3]
    order = np.argsort(kind, kind="stable")
    x, y, kind = side[0][order], side[1][order], kind[order]
    cuts = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    return [(x[i:j], y[i:j], int(kind[i] >> 1), int(kind[i] & 1)) for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(kind)])]


def by_class(a, b, n_bins: int, upper: float) -> np.ndarray:
    """``by_point`` with equal weights taken together, so that a distance costs a few nanoseconds. b may be a itself."""
    out = np.zeros((2, 2, n_bins), dtype=np.int64)
    left = classes(a)
    right = left if b is a else classes(b)
    for i, (xa, ya, wa, ga) in enumerate(left):
        for j, (xb, yb, wb, gb) in enumerate(right):
            if b is a and j < i:
                continue
            n = (plain_same(xa, ya, n_bins, upper) if b is a and i == j else plain(xa, ya, xb, yb, n_bins, upper)) * (wa * wb)
            out[ga, gb] += n
            if b is a and i < j:
                out[gb, ga] += n
    return out


def by_column(a, b, n_bins: int, upper: float) -> np.ndarray:
    """``by_point`` where b has few distinct x: its points of one x are a sorted column.

    For a point of a and an edge, the points of a column within that distance are a range of it, read from running counts over
    cells. Points in the cells at the two ends of a range, and in the next ones, are compared one by one. Work grows with
    points x columns x bins instead of points x points.
    """
    order = np.lexsort((a[1], a[0]))  # neighbours read the same cells
    xa, ya, wa, ga = (v[order] for v in a)
    order = np.lexsort((b[1], b[0]))
    xb, yb, wb, gb = (v[order] for v in b)
    starts = np.flatnonzero(np.r_[True, xb[1:] != xb[:-1]])
    edges = np.r_[np.arange(1, n_bins) * (upper / n_bins), upper]
    weights = np.stack([wa * (ga == 0), wa * (ga == 1)]).astype(float)
    least = 1e-6 * upper + 1e-9 * max(np.abs(ya).max(), np.abs(yb).max())
    within, out = np.zeros((n_bins, 2, 2)), np.zeros((2, 2, n_bins))
    for lo, hi in zip(starts, np.r_[starts[1:], len(xb)]):
        x, y, w, g = xb[lo], yb[lo:hi], wb[lo:hi], gb[lo:hi]
        cells = 1 << int(32 * (hi - lo)).bit_length()
        cell = max((y[-1] - y[0]) / cells, least)
        inside = np.minimum((y - y[0]) / cell, cells - 1).astype(np.intp) + 3  # three empty cells at either end
        number = np.r_[0, np.cumsum(np.bincount(inside, minlength=cells + 9))]
        near = np.r_[0, number[3:] - number[:-3]]  # points in a cell and its neighbours
        if near.max() > CROWD:
            out += by_point((xa, ya, wa, ga), (xb[lo:hi], y, w, g), n_bins, upper)
            continue
        below = np.r_[0, np.cumsum(np.where(g == 0, w, 1j * w))][np.r_[0, number[:-1]]]  # weight under the neighbours of a cell
        unsure = near > 0
        place, dx = (ya - y[0]) / cell + 3, xa - x
        dx2, found = dx * dx, []
        for k, r in enumerate(edges):
            i, j = np.searchsorted(dx, [-r * (1 + 1e-9), r * (1 + 1e-9)], side="left")
            n = j - i
            if not n:
                continue
            h = np.sqrt(np.maximum(r * r - dx2[i:j], 0)) / cell
            ends = np.concatenate((place[i:j] + h, place[i:j] - h))
            np.clip(ends, 1, cells + 5, out=ends)
            ends = ends.astype(np.intp)
            t = below.take(ends)
            t = (t[:n] - t[n:]).view(float).reshape(n, 2)
            within[k] += weights[:, i:j] @ t
            u = np.flatnonzero(unsure.take(ends))
            if len(u):
                at = u % n
                top, bottom = ends[at], ends[at + n]
                upward = u < n
                first = np.where(upward, top - 1, bottom - 1)
                last = np.where(upward, top + 1, np.minimum(bottom + 1, top - 2))
                found.append((at + i, np.full(len(u), k), upward, number[first], number[last + 1]))
        if found:
            p, k, upward, first, last = (np.concatenate(v) for v in zip(*found))
            size = np.maximum(last - first, 0)
            r = np.repeat(np.arange(len(p)), size)
            q = np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size) + first[r]
            p, k, upward = p[r], k[r], upward[r]
            dy = ya[p] - y[q]
            hit = bins_of(np.sqrt(dx2[p] + dy * dy), n_bins, upper) <= k
            change = (hit.astype(float) - ~upward) * wa[p] * w[q]  # a lower end is counted as inside, an upper one as outside
            within += np.bincount((k * 2 + ga[p]) * 2 + g[q], change, n_bins * 4).reshape(n_bins, 2, 2)
    return out + np.diff(within, axis=0, prepend=0).transpose(1, 2, 0)


def coincident(a, b) -> np.ndarray:
    """Pairs at distance zero: counts (group of a, group of b)."""
    _, at = np.unique(np.r_[a[0] + 1j * a[1], b[0] + 1j * b[1]], return_inverse=True)
    size, n = at.max() + 1, len(a[0])
    side = lambda at, w, g: [np.bincount(at[g == i], w[g == i], size) for i in (0, 1)]
    return np.array([[x @ y for y in side(at[n:], b[2], b[3])] for x in side(at[:n], a[2], a[3])])


def histogram(a, b, *, n_bins: int, upper: float, zeros: bool) -> np.ndarray:
    """Pairs of a and b at most ``upper`` apart: whole counts (group of a, group of b, bin); without ``zeros`` none at distance zero.

    A side is (x, y, w, g): doubles, whole weights and groups 0 or 1. b may be a itself.
    """
    if not len(a[0]) or not len(b[0]):
        return np.zeros((2, 2, n_bins), dtype=np.int64)
    if int(a[2].sum()) * int(b[2].sum()) >= EXACT:  # counts add up over the digits of a weight
        big = 0 if a[2].max() >= b[2].max() else 1
        parts = []
        for part in ((a, b)[big][2] >> 20, (a, b)[big][2] & ((1 << 20) - 1)):
            side = [a, b]
            side[big] = ((a, b)[big][0], (a, b)[big][1], part, (a, b)[big][3])
            parts.append(histogram(*side, n_bins=n_bins, upper=upper, zeros=zeros))
        return (parts[0] << 20) + parts[1]
    columns = [len(np.unique(b[0])), len(np.unique(b[1]))]
    if len(a[0]) * len(b[0]) <= FEW:
        out = by_pair(a, b, n_bins, upper)
    elif 5 * min(columns) * n_bins >= len(b[0]):  # a look at a range costs about five distances
        kinds = len(np.unique(a[2] * 2 + a[3])) * len(np.unique(b[2] * 2 + b[3]))
        few = kinds * CLASS_PAIRS <= len(a[0]) * len(b[0]) and n_bins < 254
        out = (by_class if few else by_point)(a, b, n_bins, upper)
    else:
        turn = (0, 1, 2, 3) if columns[0] <= columns[1] else (1, 0, 2, 3)
        out = by_column([a[i] for i in turn], [b[i] for i in turn], n_bins, upper)
    if not zeros:
        out[:, :, 0] -= coincident(a, b).astype(out.dtype)
    return np.rint(out).astype(np.int64)


def by_kind(a, b, *, kinds: int, n_bins: int, upper: float, zeros: bool) -> np.ndarray:
    """``histogram`` for ``kinds`` groups, 2 or 4: the second bit of four tells points by another label. Each pair is looked at once."""
    if kinds == 2:
        return histogram(a, b, n_bins=n_bins, upper=upper, zeros=zeros)
    parts = lambda s: [(*(v[s[3] >> 1 == k] for v in s[:3]), s[3][s[3] >> 1 == k] & 1) for k in (0, 1)]
    left, out = parts(a), np.zeros((2, 2, 2, 2, n_bins), dtype=np.int64)
    right = left if b is a else parts(b)
    for i, j in ((0, 0), (0, 1), (1, 1)) if b is a else ((0, 0), (0, 1), (1, 0), (1, 1)):
        n = histogram(left[i], right[j], n_bins=n_bins, upper=upper, zeros=zeros)
        out[i, :, j] += n
        if b is a and i < j:
            out[j, :, i] += n.transpose(1, 0, 2)
    return out.reshape(4, 4, n_bins)


def tile_counts(sample, columns: dict, inner: list[str], *, n_bins: int, upper: float, kinds: int = 2) -> pa.Table:
    """Counts that are not zero of every tile among the rows: (sample_id, f, lag, g, g2, bin, n).

    ``inner`` names the columns that tell tiles apart. Lag -1 marks the left side; the right sides are 1, with pairs at distance zero,
    and 0, without them.
    """
    order = np.lexsort([columns["lag"], *[columns[c] for c in reversed(inner)]])
    columns = {c: v[order] for c, v in columns.items()}
    change = lambda names: np.flatnonzero(np.r_[True, np.any([columns[c][1:] != columns[c][:-1] for c in names], axis=0), True])
    left, found = None, []
    tiles, ends = change(inner), change([*inner, "lag"])
    for lo, hi in zip(ends[:-1], ends[1:]):
        side = tuple(columns[c][lo:hi] for c in ("x_um", "y_um", "w", "g"))
        lag = int(columns["lag"][lo])
        tile = np.searchsorted(tiles, lo, side="right")
        if lag < 0:
            left, held = side, tile
        elif left is not None and held == tile:
            n = by_kind(left, side, kinds=kinds, n_bins=n_bins, upper=upper, zeros=lag != 0)
            g, g2, k = np.nonzero(n)
            found.append((np.full(len(k), columns["f"][lo]), np.full(len(k), lag), g, g2, k, n[g, g2, k]))
    return counts_table(sample, found)


def counts_table(sample, found: list) -> pa.Table:
    arrays = [np.concatenate(v) for v in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 6
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    given = [pa.array(v, kind) for v, kind in zip(arrays, kinds)]
    return pa.table([pa.array([sample.as_py()] * len(arrays[0]), sample.type), *given], names=["sample_id", "f", "lag", "g", "g2", "bin", "n"])


def collapsed(columns: dict) -> dict:
    """Distinct points of a tile in order of their frames, with their multiplicity ``w``."""
    names = ("f", "own", "x_um", "y_um", "g")
    order = np.lexsort([columns[c] for c in reversed(names)])
    columns = {c: columns[c][order] for c in names}
    new = np.flatnonzero(np.r_[True, np.any([v[1:] != v[:-1] for v in columns.values()], axis=0)])
    return {c: v[new] for c, v in columns.items()} | {"w": np.diff(np.r_[new, len(order)])}


def frame_counts(sample, columns: dict, frames: range, *, n_bins: int, upper: float, kinds: int = 2) -> pa.Table:
    """Counts of one tile for each of ``frames``, with the columns of ``tile_counts``: lag 0 without pairs at distance zero, and lag 1.

    ``own`` is 1 for the points of the tile and 0 for those that only reach it.
    """
    columns = collapsed(columns)
    side = lambda lo, hi: tuple(columns[c][lo:hi] for c in ("x_um", "y_um", "w", "g"))
    place = columns["f"] * 2 + columns["own"]
    at = lambda f, own: int(np.searchsorted(place, 2 * f + own))
    pairs = lambda a, b, zeros: by_kind(a, b, kinds=kinds, n_bins=n_bins, upper=upper, zeros=zeros)
    found = []
    for f in frames:
        lo, own, hi, end = at(f, 0), at(f, 1), at(f + 1, 0), at(f + 2, 0)
        if own == hi:
            continue
        here = side(own, hi)
        n = {0: pairs(here, here, False) + pairs(here, side(lo, own), False), 1: pairs(here, side(hi, end), True)}
        for lag, m in n.items():
            g, g2, k = np.nonzero(m)
            found.append((np.full(len(k), f), np.full(len(k), lag), g, g2, k, m[g, g2, k]))
    return counts_table(sample, found)
