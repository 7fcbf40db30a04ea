"""Pairs of dense frames: counted tile by tile, with the counts of a plain comparison of all points."""

import math

import numpy as np
import pytest

from stipple.operators import dense_pairs as dp
from stipple.operators import pairs as pr


def side(rng, n, xs, ys, most=3):
    return rng.choice(xs, n), rng.choice(ys, n), rng.integers(1, most, n), rng.integers(0, 2, n)


def plain(a, b, n_bins, upper):
    out, w = np.zeros((2, 2, n_bins), dtype=int), upper / n_bins
    for xa, ya, wa, ga in zip(*a):
        for xb, yb, wb, gb in zip(*b):
            d = math.sqrt((xa - xb) ** 2 + (ya - yb) ** 2)
            if d <= upper:
                out[ga, gb, next((i for i in range(n_bins) if i * w <= d < (i + 1) * w), n_bins - 1)] += wa * wb
    return out


@pytest.mark.parametrize("ys", [np.arange(30) * 0.1, np.linspace(0, 7, 5000), np.linspace(1, 1 + 1e-8, 50), np.array([0.5])])
def test_both_ways_match_a_plain_comparison(ys):
    rng = np.random.default_rng(5)
    a, b = side(rng, 150, np.arange(12) * 0.3, ys), side(rng, 120, np.arange(12) * 0.3, ys)
    want = plain(a, b, 30, 3.0)
    assert np.array_equal(dp.by_point(a, b, 30, 3.0), want) and np.array_equal(dp.by_column(a, b, 30, 3.0), want)


def test_large_weights_stay_whole():
    rng = np.random.default_rng(6)
    a, b = side(rng, 90, np.arange(5) * 0.3, np.linspace(0, 3, 80)), side(rng, 80, np.arange(5) * 0.3, np.linspace(0, 3, 80))
    heavy = (a[0], a[1], (a[2] << 50) + 1, a[3])
    got = dp.histogram(heavy, b, n_bins=10, upper=3.0, zeros=True)
    assert np.array_equal(got, (plain(a, b, 10, 3.0) << 50) + plain((*a[:2], a[2] * 0 + 1, a[3]), b, 10, 3.0))


@pytest.mark.parametrize("hot", [20_000, 300])
def test_dense_movies_make_no_row_per_pair(spark, hot):
    rng = np.random.default_rng(7)
    n = 2_400
    x, y, f, g = rng.integers(1, 11, n) * 0.3, rng.integers(0, 600, n) / 100, rng.integers(3, 6, n), rng.integers(0, 3, n)
    rows = [(4, int(k), float(p), float(q), ("On", "Not-on", "unknown")[i]) for k, p, q, i in zip(f, x, y, g)]
    counts = pr.grouped_pair_counts(spark.createDataFrame(rows, "sample_id long, frame int, x_um double, y_um double, grp string"),
                                    max_distance=3.0, n_bins=30, hot_points=hot)
    assert "Join" not in counts._jdf.queryExecution().optimizedPlan().toString() or hot < n
    got = {(r["component"], r["grp"], r["frame"], r["bin"]): r["n"] for r in counts.collect()}
    want = {}
    for k in (3, 4, 5):
        for lag in (0, 1):
            a, b = (tuple(v[(f == m) & (g < 2)] for v in (x, y, np.ones(n, dtype=int), g)) for m in (k, k + lag))
            h = dp.by_point(a, b, 30, 3.0).astype(int)
            if not lag:
                dx, dy = a[0][:, None] - a[0], a[1][:, None] - a[1]
                for i in (0, 1):
                    for j in (0, 1):
                        h[i, j, 0] -= int(((dx == 0) & (dy == 0))[a[3] == i][:, a[3] == j].sum())
            names = {(0, 0): "total", (1, 1): "total", (0, 1): "cross", (1, 0): "cross"} if lag else {(0, 0): "background", (1, 1): "background", (0, 1): "same_cross_background"}
            for (i, j), name in names.items():
                for bin_ in np.flatnonzero(h[i, j]):
                    want[name, ("On", "Not-on")[i], k, int(bin_)] = int(h[i, j, bin_]) * (2 if name == "same_cross_background" else 1)
    assert got == want


@pytest.mark.parametrize("ys", [np.arange(30) * 0.1, np.round(np.linspace(900, 105_000, 4_000), 2) / 35_000, np.array([0.5])])
def test_equal_weights_are_taken_together(ys):
    rng = np.random.default_rng(8)
    a, b = side(rng, 700, np.arange(1, 51) * 0.06, ys), side(rng, 650, np.arange(1, 51) * 0.06, ys)
    for left, right in ((a, b), (a, a)):
        assert np.array_equal(dp.by_class(left, right, 30, 3.0), dp.by_point(left, right, 30, 3.0))
    far = (b[0] + 40.0, b[1] - 40.0, b[2], b[3])
    assert not dp.by_class(a, far, 30, 3.0).any() and np.array_equal(dp.by_class(a, b, 200, 0.7), dp.by_point(a, b, 200, 0.7))


def test_points_move_once_and_equal_ones_meet_in_their_tile(spark):
    rng = np.random.default_rng(9)
    n = 900
    x, y, f, g = rng.integers(-5, 40, n) * 0.3, rng.integers(-20, 90, n) / 10, rng.integers(-2, 7, n), rng.integers(0, 2, n)
    rows = [(4, int(k), float(p), float(q), ("On", "Not-on")[i]) for k, p, q, i in zip(f, x, y, g)]
    points = spark.createDataFrame(rows + rows[:300], "sample_id long, frame int, x_um double, y_um double, grp string")
    whole, cut = (pr.grouped_pair_counts(points, max_distance=3.0, n_bins=30, hot_points=h) for h in (20_000, 100))
    assert "Union" not in whole._jdf.queryExecution().optimizedPlan().toString()
    got = {tuple(r) for r in whole.collect()}
    assert got == {tuple(r) for r in cut.collect()} and len(got) > 1_000


@pytest.mark.parametrize("hot", [30, pr.HOT_TILE_POINTS])
def test_two_labelings_in_one_pass_match_two_passes(spark, hot):
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(0, 2)), int(rng.integers(0, 3)), float(rng.integers(0, 40) * 0.25), float(rng.integers(0, 40) * 0.25),
             str(rng.choice(["On", "Not-on"])), str(rng.choice(["On", "Not-on", "no"], p=[0.5, 0.45, 0.05]))) for _ in range(600)]
    points = spark.createDataFrame(rows, "sample_id long, frame int, x_um double, y_um double, grp string, other string")
    one = pr.relabeled_pair_counts(points, "other", max_distance=3.0, n_bins=12, hot_points=hot)
    known = points.where("other <> 'no'")
    two = (known, known.drop("grp").withColumnRenamed("other", "grp"))
    for got, side in zip(one, two):
        want = pr.grouped_pair_counts(side, max_distance=3.0, n_bins=12, hot_points=hot)
        assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("name", ["method_curve_comparison", "relabel_invariance"])
def test_queries_of_two_labelings_meet_their_points_once(spark, monkeypatch, name):
    from stipple import catalog
    from stipple.catalog.registry import runnable

    calls, count = [], pr.counts_of_tiles
    monkeypatch.setattr(pr, "counts_of_tiles", lambda *a, **k: calls.append(1) or count(*a, **k))
    runnable(catalog.load()[name])(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
