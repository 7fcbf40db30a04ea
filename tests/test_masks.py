"""Support windows, regions, contact geometry, thresholds and display limits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stipple.operators import geometry as ge
from stipple.operators import pixels as px
from stipple.operators import regions as rg


def mask_of(spark, image, block=0):
    return spark.createDataFrame([(block, int(y), int(x)) for y, x in zip(*np.nonzero(image))], "block int, y int, x int")


def image_of(df, shape):
    out = np.zeros(shape, bool)
    for r in df.collect():
        out[r["y"], r["x"]] = True
    return out


def flood(image, steps):
    """Plain flood fill for comparison."""
    seen, parts = np.zeros(image.shape, bool), []
    for start in zip(*np.nonzero(image)):
        if seen[start]:
            continue
        todo, part = [start], []
        seen[start] = True
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            for dy, dx in steps:
                q = (y + dy, x + dx)
                if 0 <= q[0] < image.shape[0] and 0 <= q[1] < image.shape[1] and image[q] and not seen[q]:
                    seen[q] = True
                    todo.append(q)
        parts.append(part)
    return parts


FOUR = [(0, 1), (1, 0), (0, -1), (-1, 0)]
EIGHT = FOUR + [(1, 1), (1, -1), (-1, 1), (-1, -1)]


@pytest.mark.parametrize("seed,density", [(1, 0.35), (2, 0.6)])
def test_regions_match_flood_fill(spark, seed, density):
    rng = np.random.default_rng(seed)
    image = rng.random((17, 23)) < density
    want = np.zeros(image.shape, bool)
    for part in flood(image, EIGHT):
        if len(part) >= 5:
            for p in part:
                want[p] = True
    kept = rg.keep_large(mask_of(spark, image), ["block"], width=23, minimum=5)
    assert (image_of(kept, image.shape) == want).all()
    holes = np.zeros(image.shape, bool)
    for part in flood(~want, FOUR):
        edge = any(y in (0, 16) or x in (0, 22) for y, x in part)
        if not edge and len(part) < 4:
            for p in part:
                holes[p] = True
    got = rg.enclosed_holes(mask_of(spark, want), ["block"], height=17, width=23, limit=4)
    assert (image_of(got, image.shape) == holes).all()


def test_region_and_hole_limits(spark):
    image = np.zeros((20, 40), bool)
    image[2:6, 2:10] = True  # exactly 32 pixels stay
    image[10:12, 2:17] = True
    image[12, 2] = True  # 31 pixels go
    kept = rg.keep_large(mask_of(spark, image), ["block"], width=40)
    assert kept.count() == 32
    ring = np.ones((12, 12), bool)
    ring[2:10, 2:10] = False  # a hole of exactly 64 stays open
    assert rg.enclosed_holes(mask_of(spark, ring), ["block"], height=12, width=12).count() == 0
    ring[2, 2] = True
    assert rg.enclosed_holes(mask_of(spark, ring), ["block"], height=12, width=12).count() == 63


@pytest.mark.parametrize("tile,side", [(2, 21), (8, 40)])
def test_regions_of_many_tiles(spark, tile, side):
    """Random images and a spiral that winds through every tile: labels equal those of a flood fill, whatever the tile."""
    rng = np.random.default_rng(side)
    spiral = np.zeros((side, side), bool)
    y, x, dy, dx = 0, 0, 0, 1
    for _ in range(side * side):
        spiral[y, x] = True
        ahead, beyond = (y + dy, x + dx), (y + 2 * dy, x + 2 * dx)
        blocked = not (0 <= ahead[0] < side and 0 <= ahead[1] < side)
        if blocked or (0 <= beyond[0] < side and 0 <= beyond[1] < side and spiral[beyond]):
            dy, dx = dx, -dy
            if not (0 <= y + dy < side and 0 <= x + dx < side) or spiral[y + dy, x + dx]:
                break
            continue
        y, x = ahead
    images = [rng.random((side, side)) < d for d in (0.3, 0.45, 0.6)] + [spiral]
    for diagonal in (True, False):
        rows = [(b, int(i), int(j)) for b, image in enumerate(images) for i, j in np.argwhere(image)]
        mask = spark.createDataFrame(rows, "block int, y int, x int")
        for height in (side, None) if diagonal else (side,):
            got = rg.label_runs(rg.row_runs(mask, ["block"]), ["block"], width=side, height=height, diagonal=diagonal, tile=tile)
            found = {(r.block, r.y, x): r.component for r in got.collect() for x in range(r.x0, r.x1 + 1)}
            want = {}
            for b, image in enumerate(images):
                for region in flood(image, EIGHT if diagonal else FOUR):
                    smallest = min(i * side + j for i, j in region)
                    want.update({(b, i, j): smallest for i, j in region})
            assert found == want


def test_incomplete_window_is_unknown_not_empty(spark):
    frames = spark.createDataFrame([(0, 0, True), (1, 0, True), (2, 1, True), (3, 1, False)], "frame int, block int, participating boolean")
    b = px.block_validity(frames, window=2)
    assert {r["block"]: (r["valid"], r["reason"]) for r in b.collect()} == {0: (True, ""), 1: (False, "incomplete_support_block")}
    none = spark.createDataFrame([], "block int, y int, x int")
    a = {r["block"]: r["full_px"] for r in px.mask_areas(none, b, spark.createDataFrame([(0, 0)], "y int, x int")).collect()}
    assert a == {0: 0, 1: None}


def ellipse(spark, x, y, a, b):
    return spark.createDataFrame([("u", 0, x, y, a, b)], "uid string, block int, x_px double, y_px double, x_se_px double, y_se_px double")


@pytest.mark.parametrize("x,contact", [(3.7, True), (3.71, False)])
def test_tangent_contact_counts(spark, x, contact):
    mask = spark.createDataFrame([(0, 3, 3)], "block int, y int, x int")
    q = ge.contact(ellipse(spark, x, 3.0, 0.2, 0.2), mask, "x_se_px", "y_se_px", on=["block"], height=9, width=9)
    got = [r["min_q"] for r in q.collect()]
    assert bool(got and got[0] <= 1 + 1e-9) is contact


def test_corner_and_field_of_view(spark):
    mask = spark.createDataFrame([(0, 3, 3)], "block int, y int, x int")
    corner = ge.contact(ellipse(spark, 3.7, 3.7, 0.2, 0.2), mask, "x_se_px", "y_se_px", on=["block"], height=9, width=9)
    assert all(r["min_q"] > 1 + 1e-12 for r in corner.collect())
    out = ellipse(spark, -0.4, 3.0, 0.2, 0.2)
    assert out.select(ge.leaves_image(F.col("x_px"), F.col("y_px"), F.col("x_se_px"), F.col("y_se_px"), height=9, width=9)).first()[0]


def test_contact_matches_full_enumeration_for_small_and_huge_ellipses(spark):
    rng = random.Random(5)
    pts = [(f"u{i}", i % 2, rng.uniform(-2, 22), rng.uniform(-2, 22), rng.choice([0.2, 0.9, 3.0, 9.5]), rng.choice([0.3, 1.4, 12.0])) for i in range(120)]
    mask = sorted({(rng.randint(0, 1), rng.randint(0, 19), rng.randint(0, 19)) for _ in range(40)})
    df = spark.createDataFrame(pts, "uid string, block int, x_px double, y_px double, x_se_px double, y_se_px double")
    m = spark.createDataFrame(mask, "block int, y int, x int")
    got = {r["uid"]: r["min_q"] for r in ge.contact(df, m, "x_se_px", "y_se_px", on=["block"], height=20, width=20).collect()}
    for u, blk, x, y, a, b in pts:
        q = min((max(abs(x - mx) - 0.5, 0) / a) ** 2 + (max(abs(y - my) - 0.5, 0) / b) ** 2 for k, my, mx in mask if k == blk)
        if q <= 1:
            assert got[u] == pytest.approx(q, abs=1e-12)
        else:
            assert got.get(u, 9.0) > 1


def test_label_precedence(spark):
    p = spark.createDataFrame(
        [("a", 0, 0, False, "missing_mask_block"), ("b", 0, 0, True, "missing_mask_block"), ("c", 0, 0, True, ""), ("d", 0, 0, True, ""), ("e", 0, 0, True, "")],
        "uid string, frame int, block int, qc boolean, frame_reason string").withColumns({
            "x_px": F.lit(5.0), "y_px": F.lit(5.0), "x_se_px": F.lit(0.2), "y_se_px": F.lit(0.2)})
    hit = spark.createDataFrame([("b", 0.0), ("c", 0.5), ("d", 0.5)], "uid string, min_q double")
    zero = spark.createDataFrame([("d", 0.9)], "uid string, min_q double")
    got = {r["uid"]: r["label"] for r in ge.decide_labels(p, hit, zero, height=12, width=12).collect()}
    assert got == {"a": "excluded_qc", "b": "unknown", "c": "mito-compatible", "d": "unknown", "e": "non-mito-compatible"}


def test_polygon_and_raster_differ_at_the_border(spark):
    v = spark.createDataFrame([(0, 1.0, 1.0), (1, 4.0, 1.0), (2, 4.0, 4.0), (3, 1.0, 4.0)], "idx int, x double, y double")
    e = ge.polygon_edges(v)
    p = spark.createDataFrame([(3.8, 2.0), (4.2, 2.0), (2.0, 2.0)], "x double, y double").join(e)
    exact = [r[0] for r in p.select(ge.inside_polygon(F.col("x"), F.col("y"), F.col("edges"))).collect()]
    raster = [r[0] for r in p.select(ge.inside_polygon(F.rint("x"), F.rint("y"), F.col("edges"))).collect()]
    assert exact == [True, False, True] and raster != exact


def test_contrast_limits_of_a_ramp(spark):
    df = spark.range(65536).select(F.lit(0).alias("frame"), (F.col("id") / 256).cast("int").alias("y"), (F.col("id") % 256).cast("int").alias("x"), F.col("id").cast("double").alias("value"))
    r = px.contrast_limits(df).first()
    assert (r["low_bin"], r["high_bin"], r["flat_fallback"]) == (655, 64880, False)
    flat = px.contrast_limits(df.withColumn("value", F.lit(400.0))).first()
    assert flat["flat_fallback"]


def test_display_window_fallbacks(spark):
    roi = spark.createDataFrame([(0, 0), (0, 1)], "y int, x int")
    kw = dict(probs=(0.0, 1.0), fixed=(10.0, 20.0))
    df = lambda v: spark.createDataFrame([(0, 0, i, float(x)) for i, x in enumerate(v)], "frame int, y int, x int, value double")
    assert px.display_window(df([0, 0]), roi, **kw).first()["low"] == 10.0
    same = px.display_window(df([7, 7]), roi, **kw).first()
    assert (same["low"], same["high"]) == (6.0, 8.0)
    r = px.display_window(df([5, 0]), roi, **kw).first()
    assert r["signal_px"] == 1


def test_overlap_counts(spark):
    a, b = mask_of(spark, np.array([[1, 1, 0]])), mask_of(spark, np.array([[0, 1, 1]]))
    r = px.overlap(a, b, ["block"]).first()
    assert (r["intersection"], r["union"], r["added"], r["removed"]) == (1, 3, 1, 1) and r["iou"] == pytest.approx(1 / 3) and r["dice"] == 0.5


def test_support_contract_names_each_fault(spark):
    """Block 0 whole, 1 without a frame, 2 with a frame of another block, 3 with a doubled frame and no validity, 4 empty, 5 declared invalid."""
    table = lambda rows: spark.createDataFrame(rows, "block int, frame int")
    whole = [(b, 2 * b + i) for b in range(6) for i in (0, 1)]
    used = [r for r in whole if r not in ((1, 3), (4, 8), (4, 9))] + [(2, 3), (3, 6)]
    declared = spark.createDataFrame([(b, {3: None, 5: False}.get(b, True), " " if b else "") for b in range(6)], "block int, valid boolean, reason string")
    got = {r.block: (r.missing, r.extra, r.valid, r.reason, r.message) for r in
           px.support_contract(table(whole), table(used), table(whole + [(1, 0)]), declared).collect()}
    bad = "incomplete_support_block"
    assert got == {
        0: (0, 0, True, "", "windows_overlap"), 1: (2, 0, False, bad, "windows_overlap"), 2: (0, 1, False, bad, "map_disagrees"),
        3: (0, 0, False, "invalid_support_block", "frame_repeated;validity_not_declared"), 4: (2, 0, False, bad, ""),
        5: (0, 0, False, "invalid_support_block", "")}
    none = px.support_contract(*[table([])] * 3, declared.limit(0))
    assert none.count() == 0


def test_points_stay_in_place_where_the_mask_is_small(spark):
    mask = spark.range(40).select((F.col("id") % 2).cast("int").alias("block"), (F.col("id") % 9).cast("int").alias("y"), (F.col("id") % 11).cast("int").alias("x"))
    near = spark.range(200).select(F.col("id").cast("string").alias("uid"), (F.col("id") % 2).cast("int").alias("block"), (F.col("id") % 7 * 1.3).alias("x_px"),
                                   (F.col("id") % 5 * 1.7).alias("y_px"), F.lit(1.0).alias("r"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a planner that knows no sizes
    try:
        d = ge.contact(near, mask, "r", "r", on=["block"], height=12, width=12)
        assert "SortMergeJoin" not in d._jdf.queryExecution().executedPlan().toString()
        want = near.crossJoin(mask.withColumnRenamed("block", "b")).where("b = block").selectExpr(
            "uid", "power(greatest(abs(x_px - x) - 0.5, 0), 2) + power(greatest(abs(y_px - y) - 0.5, 0), 2) as q").groupBy("uid").agg(F.min("q").alias("q")).where("q <= 1")
        got = {r["uid"]: r["min_q"] for r in d.where("min_q <= 1").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {r["uid"]: pytest.approx(r["q"]) for r in want.collect()} and got
