"""Pixel movies, masks, regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stipple.catalog.displacement import R_all, round_all
from stipple.catalog.registry import PIXELS, R, query
from stipple.operators import pixels as px
from stipple.operators import regions as rg
from stipple.operators.checks import split_failures
from stipple.sources.standins import BLOCK_FRAMES, GRID

SUPPORT = 2
A = repr(0.117**2)
P = f"""WITH RECURSIVE {PIXELS},
blocks AS (SELECT block, count(*) AS expected, count(*) FILTER (participating) AS seen, min(frame) AS frame_start,
  count(*) FILTER (participating) = 24 AS valid, CASE WHEN count(*) FILTER (participating) = 24 THEN '' WHEN count(*) FILTER (participating) = 0 THEN 'no_participating_frames' ELSE 'incomplete_support_block' END AS reason
  FROM frame_map GROUP BY 1),
sup AS (SELECT block, y, x, count(DISTINCT frame) AS support FROM broad JOIN frame_map USING (frame) GROUP BY ALL),
mask AS (SELECT CAST(block AS INTEGER) AS block, y, x FROM sup SEMI JOIN (SELECT block FROM blocks WHERE valid) b USING (block) WHERE support >= 2),
areas AS (SELECT block, frame_start, seen, valid, reason, CASE WHEN valid THEN coalesce(f, 0) END AS full_px, CASE WHEN valid THEN coalesce(r, 0) END AS roi_px
  FROM blocks LEFT JOIN (SELECT block, count(*) AS f, count(*) FILTER (x BETWEEN 2 AND 9 AND y BETWEEN 2 AND 9) AS r FROM mask GROUP BY 1) n USING (block))
"""


def blocks(t):
    return px.block_validity(t.frame_map, window=BLOCK_FRAMES)


def support(t):
    return px.support_counts(t.broad, t.frame_map)


def mask(t):
    return px.support_mask(support(t), blocks(t), minimum=SUPPORT)


def areas(t):
    return px.mask_areas(mask(t), blocks(t), t.roi)


@query("movie_contract", "SRC-11", f"""{P} SELECT count(DISTINCT frame) AS frames, max(y) AS max_y, max(x) AS max_x, min(value) AS min_value, max(value) AS max_value,
  count(DISTINCT frame) = 720 AND max(y) < 12 AND max(x) < 12 AND min(value) >= 0 AND max(value) <= 65535 AS meets_contract FROM pixels""")
def movie_contract(t):
    return px.contract_check(t.pixels, frames=720, height=GRID, width=GRID, low=0, high=65535)


@query("mask_metadata_violations", "PRJ-27",
       f"""{P}, m AS (SELECT block, count(*) AS frames, min(frame) AS start, max(frame) AS stop, max(y) + 1 AS height, max(x) + 1 AS width FROM pixels JOIN frame_map USING (frame) GROUP BY 1),
       s AS (SELECT block, CASE WHEN block % 6 = 1 THEN 11 ELSE height END AS height, width, CASE WHEN block % 5 = 2 THEN 'YXT' ELSE 'TYX' END AS axes,
         CASE WHEN block % 7 = 3 THEN 106.0 ELSE 117.0 END AS nm, stop - start + 1 AS length, CASE WHEN block % 4 = 3 THEN 1 ELSE 2 END AS support, CASE WHEN block % 9 = 5 THEN 4 ELSE 8 END AS fg FROM m)
       SELECT block, concat_ws(';', CASE WHEN height <> 12 OR width <> 12 OR axes <> 'TYX' THEN 'shape' END, CASE WHEN nm <> 117 THEN 'pixel_size' END,
         CASE WHEN length <> 24 THEN 'block_length' END, CASE WHEN support <> 2 THEN 'support_minimum' END, CASE WHEN fg <> 8 THEN 'connectivity' END) AS message
       FROM s WHERE height <> 12 OR width <> 12 OR axes <> 'TYX' OR nm <> 117 OR length <> 24 OR support <> 2 OR fg <> 8""")
def mask_metadata_violations(t):
    """The masks' own metadata, one row a block, with declared values that are wrong in some blocks."""
    b = F.col("block")
    own = t.pixels.join(t.frame_map.select("frame", "block"), "frame").groupBy("block").agg(
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), (F.max("frame") - F.min("frame") + 1).alias("block_frames"))
    saved = own.withColumns({
        "height": F.when(b % 6 == 1, F.lit(11)).otherwise(F.col("height")), "axes": F.when(b % 5 == 2, "YXT").otherwise("TYX"),
        "pixel_nm": F.when(b % 7 == 3, 106.0).otherwise(117.0), "support_minimum": F.when(b % 4 == 3, 1).otherwise(2),
        "foreground_connectivity": F.when(b % 9 == 5, 4).otherwise(8), "background_connectivity": F.lit(4)})
    tests = px.metadata_expectations(height=GRID, width=GRID, pixel_nm=117.0, block_frames=BLOCK_FRAMES, support_minimum=SUPPORT)
    return split_failures(saved, tests)[1].select("block", "message")


@query("block_validity", "AGG-15", f"{P} SELECT * FROM blocks")
def block_validity(t):
    return blocks(t)


@query("time_contract_violations", "PRJ-28",
       f"""{P}, e AS (SELECT frame, block FROM frame_map UNION ALL SELECT frame, block + 1 FROM frame_map WHERE frame % 100 = 7 UNION ALL SELECT frame, block FROM frame_map WHERE frame % 100 = 9),
       f AS (SELECT frame, count(*) AS n, count(DISTINCT block) AS b FROM e GROUP BY 1)
       SELECT count(*) AS frames, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (b > 1) AS several_blocks, count(*) FILTER (frame < 0) AS negative FROM f""")
def time_contract_violations(t):
    m = t.frame_map.select("frame", "block")
    faulty = m.unionByName(m.where("frame % 100 = 7").withColumn("block", F.col("block") + 1)).unionByName(m.where("frame % 100 = 9"))
    return px.contract_violations(faulty)


@query("support_participants", "PRJ-28",
       f"""{P}, q AS (SELECT block, frame FROM frame_map UNION ALL SELECT block + 1, frame FROM frame_map WHERE frame % 240 = 23),
       u AS (SELECT CASE WHEN frame % 200 = 101 THEN block + 1 ELSE block END AS block, frame FROM frame_map WHERE frame % 90 <> 7 AND block % 8 <> 6
         UNION ALL SELECT block, frame FROM frame_map WHERE frame % 150 = 31 AND frame % 90 <> 7 AND block % 8 <> 6),
       o AS (SELECT coalesce(x.block, y.block) AS block, x.frame AS f, uses, y.frame AS asked, requests, m.frame AS mapped FROM
         (SELECT block, frame, (SELECT count(*) FROM u v WHERE v.frame = u.frame) AS uses FROM u GROUP BY ALL) x
         FULL JOIN (SELECT block, frame, (SELECT count(*) FROM q v WHERE v.frame = q.frame) AS requests FROM q GROUP BY ALL) y ON x.block = y.block AND x.frame = y.frame
         LEFT JOIN frame_map m ON m.block = x.block AND m.frame = x.frame),
       c AS (SELECT block, count(f) AS present, count(*) FILTER (f IS NULL) AS missing, count(*) FILTER (asked IS NULL) AS extra,
         count(*) FILTER (uses > 1) AS repeated, count(*) FILTER (f IS NOT NULL AND mapped IS NULL) AS unmapped, count(*) FILTER (requests > 1) AS overlapping FROM o GROUP BY 1),
       d AS (SELECT *, block % 9 <> 4 AS v, CASE WHEN block % 9 = 4 AND block % 2 = 0 THEN 'drift' ELSE '' END AS r, missing + extra > 0 OR present = 0 AS bad
         FROM c WHERE block IN (SELECT block FROM frame_map))
       SELECT block, present, missing, extra, repeated, unmapped, overlapping, v AND NOT bad AS valid,
         CASE WHEN r <> '' THEN r WHEN bad THEN 'incomplete_support_block' WHEN NOT v THEN 'invalid_support_block' ELSE '' END AS reason,
         concat_ws(';', CASE WHEN repeated > 0 THEN 'frame_repeated' END, CASE WHEN unmapped > 0 THEN 'map_disagrees' END, CASE WHEN overlapping > 0 THEN 'windows_overlap' END) AS message FROM d""")
def support_participants(t):
    """Frames that really took part, with some lost, some doubled, some under a wrong block and some windows that overlap."""
    m = t.frame_map.select("block", "frame")
    moved = F.when(F.col("frame") % 200 == 101, F.col("block") + 1).otherwise(F.col("block"))
    here = m.where("frame % 90 <> 7 and block % 8 <> 6")
    participants = here.withColumn("block", moved).unionByName(here.where("frame % 150 = 31"))
    requested = m.unionByName(m.where("frame % 240 = 23").withColumn("block", F.col("block") + 1))
    b = F.col("block")
    declared = m.select("block").distinct().withColumns({
        "valid": b % 9 != 4, "reason": F.when((b % 9 == 4) & (b % 2 == 0), "drift").otherwise("")})
    return px.support_contract(m, participants, requested, declared)


@query("support_counts", "AGG-16", f"{P} SELECT CAST(block AS INTEGER) AS block, y, x, support FROM sup")
def support_counts(t):
    return support(t)


@query("support_mask", "AGG-17", f"{P} SELECT * FROM mask")
def support_mask(t):
    return mask(t)


@query("mask_roi_intersection", "JOIN-22 SET-2", f"{P} SELECT * FROM mask WHERE x BETWEEN 2 AND 9 AND y BETWEEN 2 AND 9")
def mask_roi_intersection(t):
    return px.clip_to(mask(t), t.roi)


@query("mask_areas", "AGG-18", f"""{P} SELECT block, frame_start, seen, valid, reason, full_px, roi_px, {R(f'full_px * {A}')} AS full_um2, {R(f'roi_px * {A}')} AS roi_um2 FROM areas""")
def mask_areas(t):
    return round_all(areas(t), "full_um2", "roi_um2")


@query("area_by_frame", "AGG-19",
       f"{P} SELECT block, frame, valid, {R(f'roi_px * {A}')} AS roi_um2, {R(f'full_px * {A}')} AS full_um2 FROM frame_map LEFT JOIN areas USING (block)")
def area_by_frame(t):
    return round_all(px.area_by_frame(areas(t), t.frame_map), "roi_um2", "full_um2")


AREA_LONG = f"""bf AS (SELECT frame, valid, unnest(['full_um2', 'roi_um2']) AS scope, unnest([full_px * {A}, roi_px * {A}]) AS area FROM frame_map LEFT JOIN areas USING (block))"""


@query("area_summary", "AGG-19 WIN-10",
       f"""{P}, {AREA_LONG} SELECT scope, {R('min_by(struct_pack(a := area), frame).a')} AS first, {', '.join(f"CASE WHEN bool_and(valid) THEN {R(e)} END AS {n}" for n, e in (('mean', 'avg(area)'), ('median', 'quantile_cont(area, 0.5)'), ('min', 'min(area)'), ('max', 'max(area)')))},
       count(*) FILTER (valid) AS valid_frames, count(*) AS expected_frames, CASE WHEN bool_and(valid) THEN 'available' ELSE 'unavailable_missing_mask_blocks' END AS status FROM bf GROUP BY scope""")
def area_summary(t):
    return round_all(px.area_summary(px.area_by_frame(areas(t), t.frame_map)), "first", "mean", "median", "min", "max")


@query("area_summary_complete", "AGG-19",
       f"""{P}, whole AS (SELECT block FROM frame_map GROUP BY 1 HAVING count(*) = 24), full_map AS (SELECT frame, block FROM frame_map SEMI JOIN whole USING (block)),
       n AS (SELECT block, count(*) AS f, count(*) FILTER (x BETWEEN 2 AND 9 AND y BETWEEN 2 AND 9) AS r FROM sup WHERE support >= 2 GROUP BY 1),
       bf AS (SELECT frame, unnest(['full_um2', 'roi_um2']) AS scope, unnest([coalesce(f, 0) * {A}, coalesce(r, 0) * {A}]) AS area FROM full_map LEFT JOIN n USING (block))
       SELECT scope, {R('arg_min(area, frame)')} AS first, {R('avg(area)')} AS mean, {R('quantile_cont(area, 0.5)')} AS median, {R('min(area)')} AS min, {R('max(area)')} AS max FROM bf GROUP BY scope""")
def area_summary_complete(t):
    everything = t.frame_map.withColumn("participating", F.lit(True))
    b = px.block_validity(everything, window=BLOCK_FRAMES).where("expected = 24")
    a = px.mask_areas(px.support_mask(support(t), b, minimum=SUPPORT), b, t.roi)
    s = px.area_summary(px.area_by_frame(a, everything.join(b.select("block"), "block", "left_semi")))
    return round_all(s, "first", "mean", "median", "min", "max").select("scope", "first", "mean", "median", "min", "max")


@query("time_weighted_area", "AGG-20",
       f"""{P} SELECT {R(f'min_by(struct_pack(a := roi_px), frame_start).a * {A}')} AS first_um2,
       CASE WHEN bool_and(roi_px IS NOT NULL) THEN {R(f'sum(roi_px * {A} * seen) / sum(seen)')} END AS mean_um2, count(*) AS blocks, count(roi_px) AS known_blocks FROM areas""")
def time_weighted_area(t):
    return round_all(px.time_weighted_area(areas(t)), "first_um2", "mean_um2")


@query("time_weighted_area_complete", "AGG-20",
       f"""{P}, n AS (SELECT block, min(frame) AS frame_start, count(*) AS seen FROM frame_map GROUP BY 1),
       a AS (SELECT n.*, coalesce(r, 0) AS r FROM n LEFT JOIN (SELECT block, count(*) AS r FROM sup WHERE support >= 2 AND x BETWEEN 2 AND 9 AND y BETWEEN 2 AND 9 GROUP BY 1) USING (block) WHERE seen = 24)
       SELECT {R(f'arg_min(r, frame_start) * {A}')} AS first_um2, {R(f'sum(r * {A} * seen) / sum(seen)')} AS mean_um2, count(*) AS blocks, count(r) AS known_blocks FROM a""")
def time_weighted_area_complete(t):
    """As if every frame took part; a last window of fewer frames is cut off the movie."""
    everything = t.frame_map.withColumn("participating", F.lit(True))
    b = px.block_validity(everything, window=BLOCK_FRAMES).where("expected = 24")
    return round_all(px.time_weighted_area(px.mask_areas(px.support_mask(support(t), b, minimum=SUPPORT), b, t.roi)), "first_um2", "mean_um2")


OV = ("delta_pct", "iou", "dice")


def overlap_sql(a: str, b: str, keys: str) -> str:
    return f"""o AS (SELECT {keys}, count(a.i) AS old_px, count(b.i) AS new_px, count(*) FILTER (a.i IS NOT NULL AND b.i IS NOT NULL) AS intersection, count(*) AS "union"
      FROM (SELECT *, 1 AS i FROM {a}) a FULL JOIN (SELECT *, 1 AS i FROM {b}) b USING ({keys}, y, x) GROUP BY {keys})
    SELECT {keys}, old_px, new_px, intersection, "union", new_px - intersection AS added, old_px - intersection AS removed, new_px - old_px AS delta_px,
      {R('100.0 * (new_px / nullif(old_px, 0) - 1)')} AS delta_pct, {R('intersection / "union"')} AS iou, {R('2 * intersection / (old_px + new_px)')} AS dice FROM o"""


@query("mask_overlap", "JOIN-29 AGG-21 SET-3",
       f"""{P}, loose AS (SELECT CAST(block AS INTEGER) AS block, y, x FROM sup), tight AS (SELECT block, y, x FROM pixels JOIN frame_map USING (frame) WHERE value >= 70 GROUP BY ALL),
       {overlap_sql('mask', 'tight', 'block')}""")
def mask_overlap(t):
    tight = px.support_counts(t.pixels.where("value >= 70"), t.frame_map).select("block", "y", "x")
    return round_all(px.overlap(mask(t), tight, ["block"]), *OV)


@query("adjacent_block_iou", "WIN-4",
       f"""{P}, m AS (SELECT block, y, x FROM mask WHERE x BETWEEN 2 AND 9 AND y BETWEEN 2 AND 9),
       o AS (SELECT block, count(*) FILTER (a.i = 1 AND b.i = 1) / CAST(count(*) AS DOUBLE) AS iou FROM (SELECT *, 1 AS i FROM m) a
         FULL JOIN (SELECT block - 1 AS block, y, x, 1 AS i FROM m) b USING (block, y, x) GROUP BY block)
       SELECT b.block AS block_before, b.block + 1 AS block_after, n.frame_start AS frame_after, {R('coalesce(iou, 1)')} AS iou FROM blocks b JOIN blocks n ON n.block = b.block + 1 LEFT JOIN o ON o.block = b.block""")
def adjacent_block_iou(t):
    return round_all(px.adjacent_overlap(px.clip_to(mask(t), t.roi), blocks(t)), "iou")


@query("pixel_mean_image", "AGG-47", f"{P} SELECT y, x, {R('avg(value)')} AS mean, count(*) AS frames FROM pixels GROUP BY ALL")
def pixel_mean_image(t):
    return round_all(px.mean_image(t.pixels), "mean")


ROB = """med AS (SELECT frame, quantile_cont(value, 0.5) AS median, count(*) AS positive_px FROM day_pixels WHERE value > 0 GROUP BY 1),
 rob AS (SELECT frame, median, positive_px, quantile_cont(abs(value - median), 0.5) AS mad FROM day_pixels JOIN med USING (frame) WHERE value > 0 GROUP BY ALL),
 thr AS (SELECT *, CASE WHEN positive_px >= 100 AND mad > 0 THEN median + 3 * mad / CAST('0.6744897501960817' AS DOUBLE) END AS threshold FROM rob)"""


def thresholds(t):
    return px.robust_threshold(t.day_pixels, k=3, min_pixels=100)


@query("robust_frame_threshold", "AGG-48", f"{P}, {ROB} SELECT frame, positive_px, {R_all('median', 'mad', 'threshold')} FROM thr")
def robust_frame_threshold(t):
    return round_all(thresholds(t), "median", "mad", "threshold")


@query("strong_signal_union", "SET-1 SET-6",
       f"""{P}, {ROB}, s AS (SELECT frame, y, x FROM day_pixels JOIN thr USING (frame) WHERE value > threshold), b AS (SELECT frame, y, x FROM day_pixels WHERE value >= 200)
       SELECT * FROM s UNION SELECT * FROM b""")
def strong_signal_union(t):
    broad = t.day_pixels.where("value >= 200").select("frame", "y", "x")
    return broad.unionByName(px.strong_pixels(t.day_pixels, thresholds(t))).distinct()


@query("mask_growth_violations", "SET-5 AGG-60",
       f"""{P}, {ROB}, s AS (SELECT frame, y, x FROM day_pixels JOIN thr USING (frame) WHERE value > threshold), b AS (SELECT frame, y, x FROM day_pixels WHERE value >= 200)
       SELECT * FROM b EXCEPT SELECT * FROM s""")
def mask_growth_violations(t):
    broad = t.day_pixels.where("value >= 200").select("frame", "y", "x")
    return broad.exceptAll(px.strong_pixels(t.day_pixels, thresholds(t)))


def limits_sql(high: str) -> str:
    return f"""{P}, sp AS (SELECT frame, min(value) AS lo0, max(value) AS hi0, count(*) AS total FROM day_pixels GROUP BY 1),
    z AS (SELECT frame, lo0, hi0, total, CAST(floor(greatest(0.0, least(1.0, CASE WHEN hi0 = lo0 THEN value ELSE (CAST(1 AS DOUBLE) / (hi0 - lo0)) * value - lo0 * (CAST(1 AS DOUBLE) / (hi0 - lo0)) END)) * 65535 + 0.5) AS INTEGER) AS bin FROM day_pixels JOIN sp USING (frame)),
    h AS (SELECT frame, lo0, hi0, total, bin, count(*) AS n FROM z GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY frame ORDER BY bin ROWS UNBOUNDED PRECEDING) / CAST(total AS DOUBLE) AS cdf FROM h),
    l AS (SELECT frame, lo0, hi0, min(bin) FILTER (cdf > CAST(0.01 AS DOUBLE)) AS low_bin, {high} AS high_bin FROM c GROUP BY frame, lo0, hi0),
    lim AS (SELECT *, low_bin = high_bin AS flat_fallback, CASE WHEN low_bin = high_bin THEN 0.0 ELSE low_bin / CAST(65535 AS DOUBLE) END AS low_unit,
      CASE WHEN low_bin = high_bin THEN 1.0 ELSE high_bin / CAST(65535 AS DOUBLE) END AS high_unit FROM l)
    """


LIM = limits_sql("min(bin) FILTER (cdf >= CAST(0.99 AS DOUBLE))")
LIM_COLS = f"""frame, lo0, hi0, low_bin, high_bin, flat_fallback, {R_all('low_unit', 'high_unit')}, {R('lo0 + low_unit * (hi0 - lo0)')} AS low_value, {R('lo0 + high_unit * (hi0 - lo0)')} AS high_value"""


@query("contrast_limits", "AGG-49 WIN-3", f"{LIM} SELECT {LIM_COLS} FROM lim")
def contrast_limits(t):
    return round_all(px.contrast_limits(t.day_pixels), "low_unit", "high_unit", "low_value", "high_value")


@query("contrast_limits_low_only", "AGG-50", f"{limits_sql('65535')} SELECT {LIM_COLS} FROM lim")
def contrast_limits_low_only(t):
    return round_all(px.contrast_limits(t.day_pixels, high=None), "low_unit", "high_unit", "low_value", "high_value")


@query("contrast_remap", "AGG-51",
       f"{P} SELECT frame, y, x, CAST(round_even(65535 * greatest(0.0, least(1.0, (value - 40.2) / CAST(CAST(74.0 AS DOUBLE) - CAST(40.2 AS DOUBLE) AS DOUBLE))), 0) AS INTEGER) AS mapped FROM pixels")
def contrast_remap(t):
    return px.remap(t.pixels, low=40.2, high=74.0).select("frame", "y", "x", "mapped")


@query("display_window", "AGG-52",
       f"""{P}, v AS (SELECT value FROM day_pixels SEMI JOIN roi USING (y, x) WHERE value <> 0)
       SELECT count(*) AS signal_px, {R('quantile_cont(value, 0.01)')} AS low, {R('quantile_cont(value, 0.999)')} AS high, CAST(NULL AS VARCHAR) AS fallback FROM v""")
def display_window(t):
    return round_all(px.display_window(t.day_pixels, t.roi, probs=(0.01, 0.999), fixed=(0.0, 65535.0)), "low", "high")


@query("strip_profiles", "AGG-53",
       f"""{P} SELECT 'x' AS along, frame, x AS position, {R('avg(value)')} AS mean, count(*) AS n FROM day_pixels WHERE y BETWEEN 4 AND 7 GROUP BY ALL
       UNION ALL SELECT 'y', frame, y, {R('avg(value)')}, count(*) FROM day_pixels WHERE x BETWEEN 4 AND 7 GROUP BY ALL""")
def strip_profiles(t):
    a = px.strip_profile(t.day_pixels, across="y", low=4, high=7).select(F.lit("x").alias("along"), "frame", F.col("x").alias("position"), "mean", "n")
    b = px.strip_profile(t.day_pixels, across="x", low=4, high=7).select(F.lit("y").alias("along"), "frame", F.col("y").alias("position"), "mean", "n")
    return round_all(a.unionByName(b), "mean")


@query("stage_areas", "AGG-57",
       f"""{P}, st AS (SELECT 'k2' AS method, 'support' AS stage, CAST(block AS INTEGER) AS block, y, x FROM sup UNION ALL SELECT 'k2', 'mask', block, y, x FROM mask),
       n AS (SELECT method, stage, block, count(*) AS "full", count(*) FILTER (x BETWEEN 2 AND 9 AND y BETWEEN 2 AND 9) AS roi FROM st GROUP BY ALL)
       SELECT method, stage, block, scope, px, {R(f'px * {A}')} AS um2 FROM (SELECT method, stage, block, 'full' AS scope, "full" AS px FROM n UNION ALL SELECT method, stage, block, 'roi', roi FROM n)""")
def stage_areas(t):
    tag = lambda d, s: d.select(F.lit("k2").alias("method"), F.lit(s).alias("stage"), "block", "y", "x")
    return round_all(px.stage_areas(tag(support(t), "support").unionByName(tag(mask(t), "mask")), t.roi), "um2")


@query("bright_region_coverage", "JOIN-30",
       f"""{P}, lm AS (SELECT frame, quantile_cont(value, 0.9) AS lim FROM pixels GROUP BY 1),
       br AS (SELECT frame, block, y, x FROM pixels JOIN frame_map USING (frame) JOIN lm USING (frame) SEMI JOIN roi USING (y, x) WHERE value > lim),
       ms AS (SELECT 'support' AS method, CAST(block AS INTEGER) AS block, y, x FROM sup UNION ALL SELECT 'mask', block, y, x FROM mask),
       e AS (SELECT * FROM br CROSS JOIN (VALUES ('support'), ('mask')) v(method))
       SELECT method, frame, block, count(*) AS bright_px, count(m.i) AS covered_px, {R('count(m.i) * 100.0 / count(*)')} AS coverage_pct
       FROM e LEFT JOIN (SELECT *, 1 AS i FROM ms) m USING (method, block, y, x) GROUP BY ALL""")
def bright_region_coverage(t):
    p = t.pixels.join(t.frame_map.select("frame", "block"), "frame")
    limits = t.pixels.groupBy("frame").agg(F.percentile("value", F.lit(0.9)).alias("limit"))
    masks = support(t).select(F.lit("support").alias("method"), "block", "y", "x").unionByName(mask(t).select(F.lit("mask").alias("method"), "block", "y", "x"))
    return round_all(px.bright_coverage(p, limits, t.roi, masks, methods=["support", "mask"]), "coverage_pct")


@query("crop_box", "PIX-5", f"{P} SELECT greatest(0, min(x) - 1) AS x0, greatest(0, min(y) - 1) AS y0, least(12, max(x) + 2) AS x1, least(12, max(y) + 2) AS y1 FROM mask SEMI JOIN roi USING (y, x)")
def crop_box(t):
    return px.crop_box(px.clip_to(mask(t), t.roi), height=GRID, width=GRID, margin=1)


@query("saved_subset_check", "JOIN-31",
       f"""{P}, a AS (SELECT frame, y, x, value FROM pixels WHERE x BETWEEN 3 AND 8 AND y BETWEEN 3 AND 8), b AS (SELECT frame, y, x, value FROM a WHERE value < 40)
       SELECT *, 'old' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'new' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def saved_subset_check(t):
    from stipple.operators.hierarchy import version_differences
    from stipple.operators.points import in_rectangle

    master = in_rectangle(t.pixels.select("frame", "y", "x", "value"), (3, 8), (3, 8), cols=("x", "y"))
    return version_differences(master, master.where("value < 40"))


MIN_PX, HOLE_PX = 4, 3
FLOOD = """
fg AS (SELECT block, y, x, y * 12 + x AS l FROM mask
       UNION SELECT m.block, m.y, m.x, f.l FROM fg f JOIN mask m ON m.block = f.block AND abs(m.y - f.y) <= 1 AND abs(m.x - f.x) <= 1 AND NOT (m.y = f.y AND m.x = f.x)),
comp AS (SELECT block, y, x, min(l) AS l FROM fg GROUP BY ALL),
kept AS (SELECT block, y, x FROM comp QUALIFY count(*) OVER (PARTITION BY block, l) >= 4),
bg0 AS (SELECT b.block, g.y, g.x FROM (SELECT DISTINCT block FROM kept) b CROSS JOIN grid g ANTI JOIN kept k ON k.block = b.block AND k.y = g.y AND k.x = g.x),
bg AS (SELECT block, y, x, y * 12 + x AS l FROM bg0
       UNION SELECT m.block, m.y, m.x, f.l FROM bg f JOIN bg0 m ON m.block = f.block AND abs(m.y - f.y) + abs(m.x - f.x) = 1),
bcomp AS (SELECT block, y, x, min(l) AS l FROM bg GROUP BY ALL),
holes AS (SELECT block, y, x FROM bcomp QUALIFY count(*) OVER (PARTITION BY block, l) < 3 AND NOT bool_or(y IN (0, 11) OR x IN (0, 11)) OVER (PARTITION BY block, l)),
final AS (SELECT block, y, x, false AS filled FROM kept UNION ALL SELECT block, y, x, true FROM holes)
"""


@query("large_regions", "PIX-1", f"{P}, {FLOOD} SELECT * FROM kept")
def large_regions(t):
    return rg.keep_large(mask(t), ["block"], width=GRID, height=GRID, minimum=MIN_PX)


@query("filled_holes", "PIX-2", f"{P}, {FLOOD} SELECT * FROM holes")
def filled_holes(t):
    kept = rg.keep_large(mask(t), ["block"], width=GRID, height=GRID, minimum=MIN_PX)
    return rg.enclosed_holes(kept, ["block"], height=GRID, width=GRID, limit=HOLE_PX)


@query("clean_mask", "PIX-3 PIX-4",
       f"{P}, {FLOOD} SELECT block, count(*) AS final_px, count(*) FILTER (NOT filled) AS kept_px, count(*) FILTER (filled) AS filled_px FROM final GROUP BY 1")
def clean_mask(t):
    final = rg.clean_mask(mask(t), ["block"], height=GRID, width=GRID, minimum=MIN_PX, limit=HOLE_PX)
    return final.groupBy("block").agg(F.count("*").alias("final_px"), F.count_if(~F.col("filled")).alias("kept_px"), F.count_if("filled").alias("filled_px"))
