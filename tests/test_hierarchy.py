"""Equal-weight means, bands, eligibility and node status."""

import math

import pytest
from pyspark.sql import functions as F

from stipple.operators import checks as ck
from stipple.operators import hierarchy as hi
from stipple.operators import metrics as mt


def test_replicate_band(spark):
    df = spark.createDataFrame([(i, b, v) for i, c in enumerate([[0.2, 0.8], [0.4, 0.6], [0.6, 0.4]]) for b, v in enumerate(c)], "br int, bin int, total double")
    r = hi.equal_replicate_band(df.withColumn("g", F.lit("x")), ["g"], ["total"]).orderBy("bin").collect()
    assert [x["mean"] for x in r] == pytest.approx([0.4, 0.6])
    assert [x["sd"] for x in r] == pytest.approx([0.2, 0.2]) and r[0]["sem"] == pytest.approx(0.2 / math.sqrt(3))


def test_single_replicate_has_no_spread(spark):
    df = spark.createDataFrame([("x", 1, 0, 0.5)], "g string, br int, bin int, total double")
    r = hi.equal_replicate_band(df, ["g"], ["total"]).first()
    assert r["mean"] == 0.5 and r["sd"] is None and r["sem"] is None


def hierarchy(spark, status="complete"):
    """Two cells in one replicate and one in another; signed curves of unit area."""
    shapes = {1: [1.0, 0.0, 0.0], 2: [0.5, 1.0, -0.5], 3: [-0.25, 0.0, 1.25]}
    cells = {1: ("BR1",), 2: ("BR1",), 3: ("BR2",)}
    curves = spark.createDataFrame([(c, g, b, v) for c, s in shapes.items() for g in ("On", "Not-on") for b, v in enumerate(s)],
                                   "cell int, grp string, bin int, value double")
    inv = spark.createDataFrame([(c, br[0], "WT", "complete") for c, br in cells.items()] + [(4, "BR2", "WT", status)],
                                "cell int, br string, condition string, status string")
    states = hi.cell_states(inv, curves, groups=("On", "Not-on"), n_bins=3, width=1.0)
    return states, curves


def test_area_first_two_level_mean(spark):
    states, curves = hierarchy(spark, "pending")
    s = hi.hierarchy_curves(states, curves, groups=("On", "Not-on"), n_bins=3, width=1.0)
    br1 = s.where("level = 'BR' and br = 'BR1' and grp = 'On' and view = 'area'").orderBy("bin").collect()
    assert [r["mean"] for r in br1] == pytest.approx([0.75, 0.5, -0.25])
    top = s.where("level = 'condition' and grp = 'On' and view = 'area'").orderBy("bin").collect()
    assert [r["mean"] for r in top] == pytest.approx([0.25, 0.25, 0.5])
    assert [r["sd"] for r in top] == pytest.approx([abs(a - b) / math.sqrt(2) for a, b in ((0.75, -0.25), (0.5, 0.0), (-0.25, 1.25))])


def test_conflict_blocks_its_replicate_and_condition(spark):
    states, curves = hierarchy(spark, "conflict")
    s = hi.hierarchy_curves(states, curves, groups=("On", "Not-on"), n_bins=3, width=1.0)
    assert {r["br"] for r in s.where("level = 'BR'").select("br").distinct().collect()} == {"BR1"}
    assert s.where("level = 'condition'").count() == 0
    p = {(r["level"], r["br"]): r["status"] for r in hi.node_progress(states).collect()}
    assert p[("BR", "BR2")] == p[("condition", None)] == "BLOCKED_SOURCE_CONFLICT" and p[("BR", "BR1")] == "COMPLETE"


def test_pending_cell_keeps_node_in_progress_and_is_named(spark):
    states, _ = hierarchy(spark, "pending")
    p = {(r["level"], r["br"]): (r["status"], r["expected"], r["included"]) for r in hi.node_progress(states).collect()}
    assert p[("BR", "BR2")] == ("PROGRESS", 2, 1) and p[("BR", "BR1")] == ("COMPLETE", 2, 2)
    assert hi.node_members(states).where("cell = 4").first()["reasons"] == "not_completed"


def test_ineligible_curve_reports_reasons(spark):
    c = spark.createDataFrame([(1, "On", b, v) for b, v in enumerate([0.1, -0.1, 0.0])], "cell int, grp string, bin int, value double")
    r = hi.curve_eligibility(c, ["cell"], groups=("On", "Not-on"), n_bins=3, width=1.0).first()
    assert r["reasons"] == ["On:near_zero_signed_area", "Not-on:missing_curve"]


def test_equal_replicate_mean_is_not_the_pooled_mean(spark):
    data = [("WT", "BR1", v) for v in (0.0, 0.0, 0.0)] + [("WT", "BR2", 100.0)] + [("WT", "BR3", v) for v in (50.0, 50.0)]
    df = spark.createDataFrame(data, "condition string, br string, m double").withColumn("protein", F.lit("P"))
    m = hi.two_level_metrics(df, ["m"]).where("level = 'condition'").first()
    assert m["mean"] == pytest.approx(50.0) and m["n"] == 3 and m["n_cells"] == 6
    assert mt.endpoint_descriptives(df, ["m"]).first()["pooled_cell_mean"] == pytest.approx(200 / 6)


def test_invalid_metric_is_left_out_not_zero(spark):
    df = spark.createDataFrame([("WT", "A", 1.0), ("WT", "A", None), ("WT", "B", float("nan"))], "condition string, br string, m double")
    r = {x["br"]: x for x in hi.two_level_metrics(df, ["m"]).where("level = 'BR'").collect()}
    assert r["A"]["mean"] == 1.0 and r["A"]["n"] == 1 and r["B"]["mean"] is None and r["B"]["n"] == 0


def test_counts_reject_fractions_booleans_and_partial_sets(spark):
    df = spark.createDataFrame([("3",), ("3.0",), ("2.5",), ("true",), ("-1",), (None,)], "t string")
    assert [r[0] for r in df.select(mt.parse_count(F.col("t"))).collect()] == [3, 3, None, None, None, None]


def test_completions_merge(spark):
    a = spark.createDataFrame([(1, "p", "x"), (2, "p", "x")], "sample_id int, path string, digest string")
    b = spark.createDataFrame([(1, "p", "x"), (1, "q", "x"), (2, "q", "y")], "sample_id int, path string, digest string")
    r = {x["sample_id"]: (x["paths"], x["status"]) for x in mt.merge_completions([a, b]).collect()}
    assert r == {1: (2, "complete"), 2: (2, "conflict")}


def test_split_keeps_every_row(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, -1.0)], "id int, v double")
    good, bad = ck.split_failures(df, [("present", F.col("v").isNotNull()), ("positive", F.col("v") > 0)])
    assert good.count() == 1 and {r["id"]: r["message"] for r in bad.collect()} == {2: "present;positive", 3: "positive"}
