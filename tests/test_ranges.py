"""Ranges come from the data, nothing is lost outside a fixed one, and heavy groups stay whole."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stipple.operators import distribution as ds
from stipple.operators import inference as nf
from stipple.operators import labels as lb
from stipple.operators import pairs as pr
from stipple.operators import pixels as px
from stipple.operators.skew import exact_quantiles
from stipple.sources.standins import Tables
from stipple.sources.tables import stored


def test_windows_are_anchored_at_the_first_frame(spark):
    frames = spark.range(40, 900).select(
        F.col("id").cast("int").alias("frame"), F.floor((F.col("id") - 40) / 24).cast("int").alias("block"), (F.col("id") != 130).alias("participating"))
    blocks = {r["block"]: r for r in px.block_validity(frames, window=24).collect()}
    assert len(blocks) == 36 and blocks[0]["frame_start"] == 40 and blocks[0]["valid"]
    assert not blocks[3]["valid"] and not blocks[35]["valid"]  # a missing frame; a last window of 20 frames
    seen = spark.createDataFrame([(40, 1, 1), (63, 1, 1), (64, 1, 1), (890, 2, 2), (890, 2, 2), (881, 2, 2)], "frame int, y int, x int")
    got = {(r["block"], r["y"]): r["support"] for r in px.support_counts(seen, frames).collect()}
    assert got == {(0, 1): 2, (1, 1): 1, (35, 2): 2}


def test_frame_map_follows_the_events(spark, tmp_path):
    events = spark.range(0, 4000).selectExpr(
        "id as event_id", "id % 7 as user_id", "timestamp'2024-01-02 16:00:00' + make_interval(0,0,0,0,cast(id / 4 as int)) as ts",
        "'a' as event_type", "cast(id % 90 as double) as value", "'{}' as props").where("cast(event_id / 4 as int) <> 500")
    events.write.parquet(f"{tmp_path}/events.parquet")
    frames = {r["frame"]: r for r in Tables(spark, str(tmp_path)).frame_map.collect()}
    assert min(frames) == 40 and max(frames) == 1039 and frames[40]["block"] == 0 and frames[1039]["block"] == 41
    assert not frames[540]["participating"] and frames[541]["participating"] and not frames[110]["participating"]


def test_no_frame_is_lost_from_counts(spark):
    rows = [("a", -3, "On", True), ("a", 0, "On", True), ("a", 400, "unknown", False), ("b", 2, "Not-on", True)]
    got = lb.frame_class_counts(spark.createDataFrame(rows, "sample_id string, frame int, grp string, qc boolean")).collect()
    assert len(got) == 2 * 404 and sum(r["roi_candidates"] for r in got) == 4


def test_points_without_a_place_are_counted_apart(spark):
    nan = float("nan")
    rows = [("s", 0, 0.1, 0.1), ("s", 0, None, 0.2), ("s", 0, nan, 0.2), ("s", None, 0.1, 0.1), ("s", 1, 0.2, 0.1), ("s", 1, float("inf"), 0.0)]
    points = spark.createDataFrame(rows, "sample_id string, frame int, x_um double, y_um double")
    report = pr.placement_report(points).first()
    assert (report["points_n"], report["placed"], report["no_frame"], report["no_finite_place"]) == (6, 2, 1, 3)
    counts = {r["component"]: r for r in pr.pair_counters(points, max_distance=3.0).collect()}
    assert counts["total"]["candidates"] == 1 and counts["total"]["retained"] == 1 and counts["background"]["candidates"] == 2


def test_exact_test_has_no_limit(spark):
    rnd = random.Random(1)
    a, b = [float(rnd.randint(0, 9)) for _ in range(14)], [float(rnd.randint(2, 11)) for _ in range(13)]
    df = spark.createDataFrame([("c", a, b), ("d", [3.0], [1.0, 1.0])], "comparison_id string, values_a array<double>, values_b array<double>")
    got = {r["comparison_id"]: r for r in nf.exact_permutation(df).collect()}
    states = Counter({(0, 0.0): 1})
    for v in a + b:
        grown = Counter(states)
        for (k, s), n in states.items():
            grown[k + 1, s + v] += n
        states = grown
    ends = {s: n for (k, s), n in states.items() if k == len(a)}
    total, obs = sum(a + b), sum(a)
    assert sum(ends.values()) == math.comb(27, 14) == got["c"]["partitions"]
    lower, upper = sum(n for s, n in ends.items() if s <= obs), sum(n for s, n in ends.items() if s >= obs)
    assert abs(got["c"]["p_raw"] - min(1.0, 2 * min(lower, upper) / math.comb(27, 14))) < 1e-12
    assert abs(got["c"]["difference"] - (obs / 14 - (total - obs) / 13)) < 1e-9
    assert got["d"]["partitions"] == 3 and abs(got["d"]["p_raw"] - 2 / 3) < 1e-12


def test_quantiles_beside_a_far_outlier(spark):
    rnd = np.random.default_rng(3)
    values = np.r_[rnd.normal(size=3000), 1e12]
    df = spark.createDataFrame([("k", float(v)) for v in values] + [("one", 5.0)] * 3, "k string, v double")
    got = {(r["k"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["k"], "v", [0.0, 0.3, 0.5, 1.0], slices=16, ordered=50).collect()}
    for p in (0.0, 0.3, 0.5, 1.0):
        assert abs(got["k", p] - np.quantile(values, p)) < 1e-9 * max(1.0, abs(np.quantile(values, p)))
        assert got["one", p] == 5.0


def test_stored_tables_come_back_whole(spark):
    df = spark.createDataFrame([(1, "x y", None), (2, None, [1.5])], "a int, `b c` string, d array<double>")
    back = stored(df, by=["a"])
    assert back.schema == df.schema and sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_rows_of_a_histogram_with_its_own_edges_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(ds, "ROWS_A_TASK", 50)
    rows = spark.range(1_000).select((F.col("id") % 40).alias("k"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), (F.col("id") % 97 * 0.7).alias("v"))
    h = ds.data_edge_histogram(rows, ["k"], "g", "v", n_bins=10)
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and h.rdd.getNumPartitions() >= 20
    assert h.agg(F.sum("n")).first()[0] == 1_000 and h.where("bin < 0 or bin > 9").count() == 0
