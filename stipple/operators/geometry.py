"""Contact of points with pixel masks and polygons, written as equi-joins.

A mask is cut into short horizontal runs, keyed by row and a coarse column tile. A point
lists only the few rows its ellipse reaches and meets the runs there by key: far fewer rows
move than pixels, and a range condition never turns into a nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipple.operators.skew import broadcast_if_small
from stipple.session import cut_lineage

TOLERANCE = 1e-12  # Fixed value: slack on the contact test.
TILE = 32  # columns per run tile


def mask_runs(pixels: DataFrame, on: Sequence[str]) -> DataFrame:
    """Horizontal runs (on, py, tile, x0, x1) of the mask, cut at tile borders."""
    keys = [*on, "y", "tile"]
    tiled = pixels.select(*on, "y", "x", F.floor(F.col("x") / TILE).cast("int").alias("tile"))
    # dense_rank, so that a repeated pixel does not break its run
    island = tiled.withColumn("__g", F.col("x") - F.dense_rank().over(Window.partitionBy(*keys).orderBy("x")))
    runs = island.groupBy(*keys, "__g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return runs.select(*on, F.col("y").alias("py"), "tile", "x0", "x1")


def contact(
    points: DataFrame, pixels: DataFrame, a: str, b: str, *, on: Sequence[str], height: int, width: int, uid: str = "uid",
    x: str = "x_px", y: str = "y_px", tol: float = TOLERANCE
) -> DataFrame:
    """Smallest q = (dx/a)^2 + (dy/b)^2 between a point and the given unit pixel squares: (uid, min_q).

    ``pixels`` has the ``on`` columns with y and x. The closed ellipse touches the mask exactly
    when min_q <= 1 within the tolerance; points far from any run are absent. Runs are written once; where they are few, points stay
    in place and only the smallest q of a point moves.
    """
    grow = (1 + tol) ** 0.5

    def reach(c: str, r: str, n: int, unit: int) -> Column:
        low = F.greatest(F.lit(0), F.ceil(F.col(c) - F.col(r) * grow - 0.5 - tol))
        high = F.least(F.lit(n - 1), F.floor(F.col(c) + F.col(r) * grow + 0.5 + tol))
        steps = F.sequence(F.floor(low / unit).cast("int"), F.floor(high / unit).cast("int"))
        return F.explode(F.when(low <= high, steps).otherwise(F.array().cast("array<int>")))

    near = points.select(uid, *on, x, y, F.col(a).alias("__a"), F.col(b).alias("__b"))
    near = near.withColumn("py", reach(y, "__b", height, 1)).withColumn("tile", reach(x, "__a", width, TILE))
    closest = F.least(F.greatest(F.rint(x), F.col("x0").cast("double")), F.col("x1").cast("double"))
    dx = F.greatest(F.abs(F.col(x) - closest) - 0.5, F.lit(0.0)) / F.col("__a")
    dy = F.greatest(F.abs(F.col(y) - F.col("py")) - 0.5, F.lit(0.0)) / F.col("__b")
    runs = broadcast_if_small(cut_lineage(mask_runs(pixels, on)))
    return near.join(runs, [*on, "py", "tile"]).groupBy(uid).agg(F.min(dx * dx + dy * dy).alias("min_q"))


def proximity(points: DataFrame, pixels: DataFrame, radii: Sequence[float], *, on: Sequence[str], height: int, width: int, uid: str = "uid") -> DataFrame:
    """Is a point within each radius of the mask? One pass with the largest radius answers all."""
    top = float(max(radii))
    d = contact(points.withColumn("__r", F.lit(top)), pixels, "__r", "__r", on=on, height=height, width=width, uid=uid)
    out = points.select(uid).join(d, uid, "left")
    d2 = F.col("min_q") * top * top
    return out.select(uid, *[F.coalesce(d2 <= r * r * (1 + TOLERANCE), F.lit(False)).alias(f"within_{r:g}") for r in radii])


def points_on_mask(points: DataFrame, pixels: DataFrame, *, on: Sequence[str], height: int, width: int, uid: str = "uid") -> DataFrame:
    """Points whose centre lies in a mask pixel square, edges included."""
    tiny = points.withColumn("__r", F.lit(TOLERANCE))
    q = contact(tiny, pixels, "__r", "__r", on=on, height=height, width=width, uid=uid)
    return q.where(F.col("min_q") <= 1).select(uid)


def leaves_image(x: Column, y: Column, a: Column, b: Column, *, height: int, width: int, tol: float = TOLERANCE) -> Column:
    """The box of the ellipse extends outside the closed image."""
    return (x - a < -0.5 - tol) | (x + a > width - 0.5 + tol) | (y - b < -0.5 - tol) | (y + b > height - 0.5 + tol)


def polygon_edges(vertices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per sample with its closed polygon as an array of edges; a polygon is a small fixed list."""
    v = F.transform(F.array_sort(F.collect_list(F.struct("idx", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    ring = vertices.groupBy(*by).agg(v.alias("v"))
    following = F.concat(F.slice("v", F.lit(2), F.size("v") - 1), F.slice("v", 1, 1))
    edge = lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    return ring.select(*by, F.zip_with("v", following, edge).alias("edges"))


def fixed_polygon(vertices: Sequence[tuple[float, float]]) -> Column:
    """Edge array of one polygon given as a parameter."""
    ring = [*vertices, vertices[0]]
    names = ("x1", "y1", "x2", "y2")
    return F.array(*[
        F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, (*p, *q))]) for p, q in zip(ring, ring[1:])])


def inside_polygon(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd ray crossing test against an array of edges."""
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (
        x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return F.size(F.filter(edges, crosses)) % 2 == 1


def unknown_reason(points: DataFrame, frame_map: DataFrame, blocks: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Attach the mask window of each point's frame and why it may be unknown.

    Order of reasons: frame not mapped, window absent, window invalid, frame not taking part.
    """
    fm = frame_map.select(*by, "frame", "block", "participating")
    bl = blocks.select(*by, "block", "valid", F.col("reason").alias("__why"))
    fm, bl = (broadcast_if_small(cut_lineage(side)) for side in (fm, bl))  # few windows as keys would gather all points in as many tasks
    out = points.join(fm, [*by, "frame"], "left").join(bl, [*by, "block"], "left")
    reason = (
        F.when(F.col("block").isNull(), "missing_original_frame")
        .when(F.col("valid").isNull(), "missing_mask_block")
        .when(~F.col("valid"), F.coalesce(F.nullif("__why", F.lit("")), F.lit("invalid_support_block")))
        .when(~F.col("participating"), "missing_original_frame").otherwise("")
    )
    return out.withColumn("frame_reason", reason).withColumn("block", F.coalesce("block", F.lit(-1))).drop("valid", "participating", "__why")


def decide_labels(points: DataFrame, mask_q: DataFrame, zero_q: DataFrame, *, height: int, width: int, uid: str = "uid") -> DataFrame:
    """Final label with precedence: failed QC, unknown frame, outside or blind pixels, contact.

    ``points`` carries block and frame_reason; ``mask_q`` and ``zero_q`` are (uid, min_q).
    """
    q = mask_q.select(uid, "min_q")
    z = zero_q.select(uid, F.col("min_q").alias("__z"))
    j = points.join(q, uid, "left").join(z, uid, "left")
    out = leaves_image(F.col("x_px"), F.col("y_px"), F.col("x_se_px"), F.col("y_se_px"), height=height, width=width)
    blind = F.coalesce(F.col("__z") <= 1 + TOLERANCE, F.lit(False))
    spatial = F.concat_ws(";", F.when(out, "ellipse_extends_outside_closed_FOV"), F.when(blind, "ellipse_touches_original_C1_zero_unknown_pixels"))
    touches = F.coalesce(F.col("min_q") <= 1 + TOLERANCE, F.lit(False))
    reason = F.when(~F.col("qc"), "").when(F.col("frame_reason") != "", F.col("frame_reason")).otherwise(spatial)
    label = (
        F.when(~F.col("qc"), "excluded_qc").when(reason != "", "unknown")
        .when(touches, "mito-compatible").otherwise("non-mito-compatible")
    )
    return j.select(uid, "frame", "block", label.alias("label"), reason.alias("reason"), "min_q")
