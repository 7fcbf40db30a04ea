"""Whitened rows against numpy over exact integers, and the awkward cases of the docstring."""

import math

import numpy as np
import pytest

from stipple.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, components=16):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in map(float, v)]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    c = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in kept:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        z = np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ vectors / np.sqrt(np.maximum(values, 1e-300))
        out += [(i, k + 1, n, dev, z[k], values[k] / values.sum()) for k in range(min(components, d)) if values[k] > 1e-12 * values[0]]
    return out


def compared(got, want):
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    signs = {}
    for g, w in zip(got, want):
        assert g[:4] == w[:4]
        assert abs(abs(g[4]) - abs(w[4])) < 1e-6 * max(1, abs(w[4])) and abs(g[5] - w[5]) < 1e-9 and 0 <= g[6] < 1e-4
        if abs(w[4]) > 1e-3:
            signs.setdefault(g[1], set()).add(g[4] * w[4] > 0)
    assert all(len(s) == 1 for s in signs.values())


@pytest.mark.parametrize("d", [3, 20])
def test_rows_equal_numpy(spark, d):
    rnd = np.random.default_rng(d)
    base = rnd.normal(size=(300, d)) * np.linspace(2, 0.2, d)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(7, rows[7][1]), (None, rows[3][1])]  # copies count once in the fit
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    compared(whitening.whitened_components(df).collect(), brute(rows))


def test_awkward_vectors(spark):
    rows = [(1, [0.5, 1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [0.1, -3.0]), (7, [9.0, 2.0]),
            (7, [9.0, 2.0]), (8, []), (9, [0.0, 0.0])]
    odd = [(10, [1.0, 2.0, 3.0])]  # not of the common length
    frame = spark.createDataFrame([(i, v, 0, "a", "b") for i, v in rows + odd], SCHEMA + ", `__x` string, `__i` string")
    compared(whitening.whitened_components(frame).collect(), brute([r for r in rows if r[1]]))


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [1.0, 2.0], 0)] * 3, [(1, None, 0)]):
        out = whitening.whitened_components(spark.createDataFrame(rows, SCHEMA))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_flat_directions_and_wide_values(spark):
    rnd = np.random.default_rng(1)
    flat = [(i, [float(a), float(a), float(b)]) for i, (a, b) in enumerate(rnd.integers(-5, 5, (60, 2)))]
    got = whitening.whitened_components(spark.createDataFrame([(i, v, 0) for i, v in flat], SCHEMA)).collect()
    assert {r["component"] for r in got} == {1, 2} and len(got) == 120
    compared(got, brute(flat))
    wide = [(i, [float(np.float32(a)), float(np.float32(b))]) for i, (a, b) in enumerate(rnd.normal(size=(40, 2)) * 1e9)]
    got = whitening.whitened_components(spark.createDataFrame([(i, v, 0) for i, v in wide], SCHEMA)).collect()
    want = {(r[0], r[1]): r for r in brute(wide)}
    for r in got:
        exact = want[r["vec_id"], r["component"]][3]
        assert r["deviation"] == (exact if exact < 1 << 63 else None)


def test_no_long_holds_huge_entries(spark):
    rows = [(1, [1e30, 0.0], 0), (2, [-1e30, 1.0], 0), (3, [0.0, 5.0], 0)]
    got = whitening.whitened_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got and all(r["deviation"] is None for r in got if r["vec_id"] != 3)
