"""Pair semantics, decomposition and curve summaries on hand-computed vectors."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from stipple.operators import curves as cv
from stipple.operators import decompose as dc
from stipple.operators import pairs as pr


def points(spark, data):
    return spark.createDataFrame(data, "sample_id bigint, frame int, x_um double, y_um double")


TWO = [(1, 1, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, 0.0, 0.0), (1, 2, 2.0, 0.0)]


def histogram(df, component, n):
    got = {r["bin"]: r["n"] for r in df.where(F.col("component") == component).groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    return [got.get(b, 0) for b in range(n)]


def test_two_frame_pairs(spark):
    c = pr.pair_counts(points(spark, TWO), max_distance=3.0, n_bins=3)
    assert histogram(c, "total", 3) == [1, 2, 1]
    assert histogram(c, "background", 3) == [0, 2, 2]
    k = {r["component"]: r for r in pr.pair_counters(points(spark, TWO), max_distance=3.0).collect()}
    assert (k["total"]["candidates"], k["total"]["retained"], k["total"]["zeros"]) == (4, 4, 1)
    assert (k["background"]["candidates"], k["background"]["zeros"], k["background"]["retained"]) == (8, 4, 4)


def brute(data, n_bins, top):
    w = top / n_bins
    out = {"total": [0] * n_bins, "background": [0] * n_bins}
    for a, b in itertools.product(data, data):
        if a[0] != b[0] or b[1] - a[1] not in (0, 1):
            continue
        d = math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2)
        kind = "total" if b[1] == a[1] + 1 else "background"
        if d > top or (kind == "background" and d == 0):
            continue
        i = next((i for i in range(n_bins) if i * w <= d < (i + 1) * w), n_bins - 1)
        out[kind][i] += 1
    return out


@pytest.mark.parametrize("hot", [20_000, 7])
def test_pairs_match_brute_force_also_when_frames_are_split(spark, hot):
    """A wide field with one crowded frame; splitting crowded frames must not change a count."""
    rng = random.Random(3)
    data = [(1, f, rng.uniform(-9, 20), rng.uniform(-5, 12)) for f in (0, 1, 2, 5) for _ in range(20)]
    data += [(1, 1, float(rng.randint(0, 3)), float(rng.randint(0, 3))) for _ in range(60)] + [(2, 1, 0.0, 0.0), (2, 2, 0.0, 3.0)]
    c = pr.pair_counts(points(spark, data), max_distance=3.0, n_bins=6, hot_points=hot)
    want = brute(data, 6, 3.0)
    assert histogram(c, "total", 6) == want["total"]
    assert histogram(c, "background", 6) == want["background"]


def test_grouped_pairs_of_one_point_per_group_and_frame(spark):
    data = [(1, f, x, 0.0, g) for f in range(50) for g, x in (("On", 0.0), ("Not-on", 1.0))]
    df = spark.createDataFrame(data, "sample_id bigint, frame int, x_um double, y_um double, grp string")
    n = {r["component"]: r["n"] for r in pr.grouped_pair_counts(df, max_distance=3.0, n_bins=3).groupBy("component").agg(F.sum("n").alias("n")).collect()}
    assert n == {"total": 98, "cross": 98, "same_cross_background": 100}
    assert pr.coincident_pairs(df.withColumn("sample_id", F.when(F.col("grp") == "On", 1).otherwise(2))).agg(F.sum("zeros")).first()[0] == 100
    split = pr.grouped_pair_counts(df, max_distance=3.0, n_bins=3, hot_points=1)
    assert {r[0]: r[1] for r in split.groupBy("component").agg(F.sum("n")).collect()} == n


def test_scope_drops_the_pair_that_leaves_it(spark):
    counts = spark.createDataFrame([(1, "total", f, 0, 1) for f in range(9)] + [(1, "background", f, 0, 1) for f in range(10)],
                                   "sample_id bigint, component string, frame int, bin int, n bigint")
    scopes = spark.createDataFrame([("full", 0, 10), ("a", 0, 5), ("b", 5, 10)], "scope string, start int, stop int")
    got = {(r["scope"], r["component"]): r["n"] for r in pr.pool_scopes(counts, scopes).collect()}
    assert got[("full", "total")] == 9 and got[("a", "total")] + got[("b", "total")] == 8
    assert got[("a", "background")] == got[("b", "background")] == 5


def test_decomposition_adds_up_and_recovers_beta(spark):
    counts = spark.createDataFrame([(1, "total", b, n) for b, n in enumerate([50, 20, 10, 10, 10])] + [(1, "background", b, n) for b, n in enumerate([10, 30, 20, 20, 20])],
                                   "sample_id bigint, component string, bin int, n bigint")
    d = dc.decompose(dc.dense_curves(counts, ["sample_id"], n_bins=5, width=0.6), ["sample_id"], n_bins=5)
    r = d.orderBy("bin").collect()
    assert r[0]["beta"] == pytest.approx(0.5)
    assert all(x["total"] == pytest.approx(x["inter"] + x["intra"]) for x in r)
    assert r[0]["intra_conditional"] == pytest.approx((0.5 - 0.05) / 0.5)


def curve(spark, values, w=0.2):
    return spark.createDataFrame([("c", i, i * w, (i + 1) * w, (i + 0.5) * w, v) for i, v in enumerate(values)],
                                 "id string, bin int, left_um double, right_um double, mid_um double, v double")


def test_positive_summary(spark):
    s = cv.positive_summary(curve(spark, [0.25, -0.2, 0.75]), ["id"], "v").first()
    assert s["peak_bin"] == 2 and s["peak_density"] == pytest.approx(3.75)
    assert s["positive_mass"] == pytest.approx(1.0) and s["near_mass"] == pytest.approx(0.25)
    assert s["mean_um"] == pytest.approx(0.4) and s["median_um"] == pytest.approx(0.4 + 0.25 / 0.75 * 0.2)


def test_positive_summary_is_undefined_without_mass(spark):
    s = cv.positive_summary(curve(spark, [-0.1, 0.0, -0.2]), ["id"], "v").first()
    assert s["peak_bin"] == -1 and s["mean_um"] is None and s["median_um"] is None and s["positive_mass"] == 0


def test_histogram_edges(spark):
    from stipple.functions.columns import bin_index

    edge = 3.0 / 300
    df = spark.createDataFrame([(i * edge,) for i in range(301)], "d double")
    got = [r[0] for r in df.select(bin_index(F.col("d"), 300, 3.0)).collect()]
    assert got[:300] == list(range(300)) and got[300] == 299


def test_a_full_tile_copies_no_other_tile(spark):
    """A dense spot in a wide, sparse field: only rows of tiles that it reaches are repeated, and the pairs stay the same."""
    rng = random.Random(4)
    data = [(1, f, rng.uniform(0, 60), rng.uniform(0, 60)) for f in range(3) for _ in range(150)]
    data += [(1, f, rng.uniform(24.5, 25.5), rng.uniform(24.5, 25.5)) for f in (1, 2) for _ in range(90)]
    df = points(spark, data)
    spots = pr.collapse(df, pr.FRAME_KEYS)
    plain, split = (pr.tiled_sides(spots, pr.measure(df, hot_points=h), lags=[1, 0], max_distance=1.0) for h in (10**6, 40))
    near, dense = "gx between 11 and 13 and gy between 11 and 13", "gx = 12 and gy = 12"
    for k in (0, 1):
        assert split[k].where(f"not ({near})").count() == plain[k].where(f"not ({near})").count()
        assert split[k].where(dense).count() > 2 * plain[k].where(dense).count()
    tables = [pr.pair_counts(df, max_distance=1.0, n_bins=4, hot_points=h).collect() for h in (10**6, 40)]
    assert sorted(map(tuple, tables[0])) == sorted(map(tuple, tables[1]))


def test_bins_without_an_intra_part_are_not_negative(spark):
    """Where total and background are in proportion the intra part is zero, whatever the last bit of the doubles says."""
    b = [2 * (7 * k % 11 + 1) for k in range(30)]
    t = [1_000 if k == 0 else b[k] * 3 for k in range(30)]  # more at short distances, in proportion beyond
    rows = [(s, k, c, n * m) for s, m in ((1, 1), (2, 49)) for k in range(30) for c, n in (("total", t[k]), ("background", b[k]))]
    counts = spark.createDataFrame(rows, "sample_id long, bin int, component string, n long")
    curves = dc.decompose(dc.dense_curves(counts, ["sample_id"], n_bins=30, width=0.1), ["sample_id"], n_bins=30)
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, 0.0, 0.0)], "sample_id long, frame int, x_um double, y_um double")
    quality = dc.cell_quality(points, pr.candidate_counts(points), curves, n_bins=30).collect()
    assert curves.where("intra < 0").count() > 0  # what the doubles say
    assert [(r["negative_intra_bins"], r["beta_clipped"]) for r in quality] == [(0, False)] * 2
