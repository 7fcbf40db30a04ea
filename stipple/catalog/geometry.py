"""Contact of points with masks and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from stipple.catalog import pixels as pc
from stipple.catalog.displacement import round_all
from stipple.catalog.registry import POINTS, R, query
from stipple.operators import geometry as ge
from stipple.sources.standins import GRID, ROI_VERTICES

GSQL = f"""{pc.P}, {POINTS},
pm AS (SELECT r AS frame, CAST(r % 30 AS INTEGER) AS block, r % 50 <> 7 AS participating FROM range(350) t(r)),
pb AS (SELECT block, valid, reason FROM blocks WHERE block < 28),
pt AS (SELECT p.*, coalesce(pm.block, -1) AS block,
   CASE WHEN pm.block IS NULL THEN 'missing_original_frame' WHEN pb.valid IS NULL THEN 'missing_mask_block' WHEN NOT pb.valid THEN pb.reason
        WHEN NOT pm.participating THEN 'missing_original_frame' ELSE '' END AS frame_reason
   FROM points p LEFT JOIN pm USING (frame) LEFT JOIN pb ON pb.block = pm.block),
zero AS (SELECT frame AS block, y, x FROM day_pixels WHERE value < 20),
mq AS (SELECT uid, min(power(greatest(abs(x_px - m.x) - 0.5, 0) / x_se_px, 2) + power(greatest(abs(y_px - m.y) - 0.5, 0) / y_se_px, 2)) AS q FROM pt JOIN mask m USING (block) GROUP BY uid),
zq AS (SELECT uid, min(power(greatest(abs(x_px - m.x) - 0.5, 0) / x_se_px, 2) + power(greatest(abs(y_px - m.y) - 0.5, 0) / y_se_px, 2)) AS q FROM pt JOIN zero m USING (block) GROUP BY uid),
md AS (SELECT uid, min(power(greatest(abs(x_px - m.x) - 0.5, 0), 2) + power(greatest(abs(y_px - m.y) - 0.5, 0), 2)) AS d2,
              bool_or(abs(x_px - m.x) <= 0.5 + 1e-12 AND abs(y_px - m.y) <= 0.5 + 1e-12) AS on_mask FROM pt JOIN mask m USING (block) GROUP BY uid)
"""
OUT = "(x_px - x_se_px < -0.5 - 1e-12 OR x_px + x_se_px > 11.5 + 1e-12 OR y_px - y_se_px < -0.5 - 1e-12 OR y_px + y_se_px > 11.5 + 1e-12)"
SIZE = {"height": GRID, "width": GRID}


def placed(t):
    """Points with their mask window and frame reason."""
    frames = t.spark.range(350).select(F.col("id").cast("int").alias("frame"), (F.col("id") % 30).cast("int").alias("block"), (F.col("id") % 50 != 7).alias("participating"))
    return ge.unknown_reason(t.points, frames, pc.blocks(t).where("block < 28"))


def zero_pixels(t):
    return t.day_pixels.where("value < 20").select(F.col("frame").alias("block"), "y", "x")


def mask_q(t):
    return ge.contact(placed(t), pc.mask(t), "x_se_px", "y_se_px", on=["block"], **SIZE)


def zero_q(t):
    return ge.contact(placed(t), zero_pixels(t), "x_se_px", "y_se_px", on=["block"], **SIZE)


def labels(t):
    return ge.decide_labels(placed(t), mask_q(t), zero_q(t), **SIZE)


@query("frame_unknown_reasons", "JOIN-11 JOIN-12", f"{GSQL} SELECT frame_reason, block, count(*) AS n FROM pt GROUP BY ALL")
def frame_unknown_reasons(t):
    return placed(t).groupBy("frame_reason", "block").agg(F.count("*").alias("n"))


@query("mask_contact", "JOIN-13", f"{GSQL} SELECT uid, {R('q')} AS min_q FROM mq WHERE q <= 1 + 1e-12")
def mask_contact(t):
    return round_all(mask_q(t).where(F.col("min_q") <= 1 + ge.TOLERANCE), "min_q")


@query("zero_pixel_contact", "JOIN-14", f"{GSQL} SELECT uid, {R('q')} AS min_q FROM zq WHERE q <= 1 + 1e-12")
def zero_pixel_contact(t):
    return round_all(zero_q(t).where(F.col("min_q") <= 1 + ge.TOLERANCE), "min_q")


@query("point_labels", "JOIN-15 JOIN-16",
       f"""{GSQL}, r AS (SELECT pt.*, mq.q, CASE WHEN NOT qc THEN '' WHEN frame_reason <> '' THEN frame_reason
           ELSE concat_ws(';', CASE WHEN {OUT} THEN 'ellipse_extends_outside_closed_FOV' END, CASE WHEN zq.q <= 1 + 1e-12 THEN 'ellipse_touches_original_C1_zero_unknown_pixels' END) END AS reason
         FROM pt LEFT JOIN mq USING (uid) LEFT JOIN zq USING (uid))
       SELECT uid, frame, block, CASE WHEN NOT qc THEN 'excluded_qc' WHEN reason <> '' THEN 'unknown' WHEN coalesce(q <= 1 + 1e-12, false) THEN 'mito-compatible' ELSE 'non-mito-compatible' END AS label, reason FROM r""")
def point_labels(t):
    return labels(t).select("uid", "frame", "block", "label", "reason")


@query("mask_proximity", "JOIN-17", f"{GSQL} SELECT pt.uid, coalesce(d2 <= 1 + 1e-12, false) AS within_1, coalesce(d2 <= 4 * (1 + 1e-12), false) AS within_2 FROM pt LEFT JOIN md USING (uid)")
def mask_proximity(t):
    return ge.proximity(placed(t), pc.mask(t), [1, 2], on=["block"], **SIZE)


@query("proximity_nesting_violations", "AGG-60", f"{GSQL} SELECT count(*) FILTER (d2 <= 1 AND NOT d2 <= 4) AS violations, count(*) AS points_n FROM pt LEFT JOIN md USING (uid)")
def proximity_nesting_violations(t):
    p = ge.proximity(placed(t), pc.mask(t), [1, 2], on=["block"], **SIZE)
    return p.agg(F.count_if(F.col("within_1") & ~F.col("within_2")).alias("violations"), F.count("*").alias("points_n"))


@query("points_on_mask", "JOIN-20", f"{GSQL} SELECT uid FROM md WHERE on_mask")
def points_on_mask(t):
    return ge.points_on_mask(placed(t), pc.mask(t), on=["block"], **SIZE)


def crossing_sql(x: str, y: str) -> str:
    ring = ROI_VERTICES + ROI_VERTICES[:1]
    parts = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        lit = [f"CAST({v} AS DOUBLE)" for v in (x1, y1, x2, y2)]
        if y1 != y2:
            parts.append(f"CAST((({lit[1]} > {y}) <> ({lit[3]} > {y})) AND {x} < ({lit[2]} - {lit[0]}) * ({y} - {lit[1]}) / ({lit[3]} - {lit[1]}) + {lit[0]} AS INTEGER)")
    return "(" + " + ".join(parts) + ") % 2 = 1"


@query("points_in_polygon", "JOIN-19", f"{GSQL} SELECT sample_id, count(*) FILTER ({crossing_sql('x_px', 'y_px')}) AS inside, count(*) AS points_n FROM points GROUP BY 1")
def points_in_polygon(t):
    inside = ge.inside_polygon(F.col("x_px"), F.col("y_px"), ge.fixed_polygon(ROI_VERTICES))
    return t.points.groupBy("sample_id").agg(F.count_if(inside).alias("inside"), F.count("*").alias("points_n"))


@query("polygon_raster", "JOIN-21",
       f"""{GSQL}, g AS (SELECT DISTINCT y, x FROM pixels) SELECT y, x FROM g WHERE {crossing_sql('CAST(x AS DOUBLE)', 'CAST(y AS DOUBLE)')}""")
def polygon_raster(t):
    # the raster grid is the extent of the movie itself
    inside = ge.inside_polygon(F.col("x").cast("double"), F.col("y").cast("double"), ge.fixed_polygon(ROI_VERTICES))
    return t.pixels.select("y", "x").distinct().where(inside)


@query("points_in_sample_polygon", "JOIN-19",
       f"""{GSQL}, sq AS (SELECT s_suppkey AS sample_id, 1.5 + s_suppkey % 3 AS lo, 9.5 - s_suppkey % 4 AS hi FROM supplier)
       SELECT sample_id, count(*) FILTER (x_px >= lo AND x_px < hi AND y_px >= lo AND y_px < hi) AS inside FROM points JOIN sq USING (sample_id) GROUP BY 1""")
def points_in_sample_polygon(t):
    s = F.col("s_suppkey")
    lo, hi = 1.5 + s % 3, 9.5 - s % 4
    corners = F.array(*[F.struct(F.lit(i).alias("idx"), x.cast("double").alias("x"), y.cast("double").alias("y"))
                        for i, (x, y) in enumerate([(lo, lo), (hi, lo), (hi, hi), (lo, hi)])])
    v = t.raw("supplier").select(s.alias("sample_id"), F.explode(corners).alias("v")).select("sample_id", "v.*")
    p = t.points.join(ge.polygon_edges(v, ["sample_id"]), "sample_id")
    inside = ge.inside_polygon(F.col("x_px"), F.col("y_px"), F.col("edges"))
    return p.groupBy("sample_id").agg(F.count_if(inside).alias("inside"))
