"""Point pairs across and within frames, counted into distance histograms.

Points are first collapsed to distinct coordinates with a multiplicity, then placed on a
coarse spatial tiling so that only points within reach of each other meet. Pairs are never
materialized: the join feeds a partial aggregate in the same stage.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.functions.columns import bin_index, finite
from stipple.operators import dense_pairs
from stipple.operators.skew import broadcast_if_small
from stipple.session import cut_lineage

cloudpickle.register_pickle_by_value(dense_pairs)  # tasks run it where this package is not installed

HOT_TILE_POINTS = 20_000
FRAMES_A_GROUP = 4  # frames whose tiles are counted in one call, so that sparse frames do not cost one call each
SAMPLE = "sample_id"
FRAME_KEYS = [SAMPLE, "frame"]


def has_place() -> Column:
    """A point that can be paired: it has a sample, a frame and finite coordinates."""
    here = F.col(SAMPLE).isNotNull() & F.col("frame").isNotNull()
    return here & F.coalesce(finite(F.col("x_um").cast("double")) & finite(F.col("y_um").cast("double")), F.lit(False))


def placement_report(points: DataFrame) -> DataFrame:
    """Per sample how many points enter the pair analysis and why the others don't."""
    bad = lambda c: ~F.coalesce(finite(F.col(c).cast("double")), F.lit(False))
    return points.groupBy(SAMPLE).agg(
        F.count("*").alias("points_n"), F.count_if(has_place()).alias("placed"), F.count_if(F.col("frame").isNull()).alias("no_frame"),
        F.count_if(bad("x_um") | bad("y_um")).alias("no_finite_place"))


def collapse(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct coordinates per key with their multiplicity ``w``; rows without a place are left to ``placement_report``."""
    placed = points.where(has_place()).dropna(subset=list(keys))
    return placed.groupBy(*keys, "x_um", "y_um").agg(F.count("*").alias("w"))


@dataclass(frozen=True)
class Layout:
    """What the pair join must know about the points: their extent, and the frames large enough to hold a full tile."""

    box: tuple[float, float, float, float]
    hot: DataFrame | None
    hot_points: int


def measure(points: DataFrame, *, hot_points: int = HOT_TILE_POINTS) -> Layout:
    """One aggregate pass: bounding box and largest frame; large frames are listed only if there are any."""
    sizes = points.where(has_place()).groupBy(*FRAME_KEYS).agg(
        F.count("*").alias("n"), F.min("x_um").alias("x0"), F.max("x_um").alias("x1"), F.min("y_um").alias("y0"), F.max("y_um").alias("y1"))
    top, *box = sizes.agg(F.max("n"), F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    hot = None
    if (top or 0) > hot_points:
        hot = broadcast_if_small(sizes.where(F.col("n") > hot_points).select(SAMPLE, "frame"))
    return Layout(tuple(0.0 if v is None else v for v in box), hot, hot_points)


TILE_KEYS = [SAMPLE, "f", "gx", "gy"]


def full_tiles(a: DataFrame, b: DataFrame, layout: Layout) -> DataFrame:
    """(sample, f, gx, gy, sa, sb): into how many parts the two sides of each full tile are cut.

    Only points of large frames are counted; the counts combine before they move.
    """
    def counted(side: DataFrame, frame: Column, name: str) -> DataFrame:
        large = layout.hot.select(F.col(SAMPLE).alias("__s"), F.col("frame").alias("__f"))
        inside = side.join(large, (F.col(SAMPLE) == F.col("__s")) & (frame == F.col("__f")), "left_semi")
        return inside.groupBy(*TILE_KEYS).agg(F.ceil(F.count("*") / layout.hot_points).cast("int").alias(name)).where(F.col(name) > 1)

    both = counted(a, F.col("f"), "sa").join(counted(b, F.col("f") + F.col("lag"), "sb"), TILE_KEYS, "full")
    return cut_lineage(both.select(*TILE_KEYS, F.coalesce("sa", F.lit(1)).alias("sa"), F.coalesce("sb", F.lit(1)).alias("sb")))


def tiled_sides(spots: DataFrame, layout: Layout, *, lags: Sequence[int], max_distance: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of the pair join and its keys.

    One join serves all lags: a right point is offered to each source frame it belongs to.
    Tiles have twice the reach as edge, so a point visits at most four, and none outside the
    data's own extent. Only a full tile is cut, on both sides: each left part meets each right
    part once, and no point of another tile is copied. Right columns carry the suffix ``2``; join keys are made non-NULL so that both
    sides read the same collapsed shuffle.
    """
    edge = 2.0 * max_distance
    reach = max_distance * (1 + 1e-9)

    def tile(value: Column) -> Column:
        return F.coalesce(F.floor(value / edge), F.lit(0))

    def visits(axis: str, low: float, high: float) -> Column:
        first = F.greatest(tile(F.col(axis) - reach), F.lit(math.floor(low / edge)))
        last = F.least(tile(F.col(axis) + reach), F.lit(math.floor(high / edge)))
        return F.explode(F.sequence(first, last))

    x0, x1, y0, y1 = layout.box
    source = F.coalesce(F.col("frame"), F.lit(0))
    a = spots.withColumns({"f": source, "gx": tile(F.col("x_um")), "gy": tile(F.col("y_um"))}).drop("frame")
    b = spots.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags])))
    b = b.withColumn("f", source - F.col("lag")).drop("frame").withColumn("gx", visits("x_um", x0, x1)).withColumn("gy", visits("y_um", y0, y1))
    keys = list(TILE_KEYS)
    if layout.hot is not None:
        place = F.xxhash64("x_um", "y_um")
        tiles = broadcast_if_small(full_tiles(a, b, layout))

        def cut(side: DataFrame, own: str, other: str) -> DataFrame:
            parts = {c: F.coalesce(F.col(c), F.lit(1)) for c in (own, other)}
            known = side.join(tiles, TILE_KEYS, "left").withColumns(parts)
            return known.withColumn(own, F.pmod(place, own).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

        a, b = cut(a, "sa", "sb"), cut(b, "sb", "sa")
        keys += ["sa", "sb"]
    return a, b, keys


def near_pairs(spots: DataFrame, layout: Layout, *, lags: Sequence[int], max_distance: float) -> DataFrame:
    """Pairs of collapsed points at most ``max_distance`` apart, frame f against f+lag for each lag."""
    a, b, keys = tiled_sides(spots, layout, lags=lags, max_distance=max_distance)
    b = b.withColumnsRenamed({c: f"{c}2" for c in b.columns if c not in (*keys, "lag")})
    dx, dy = F.col("x_um") - F.col("x_um2"), F.col("y_um") - F.col("y_um2")
    # a sort-merge join spills and lets skewed partitions be split; file sizes say little about either side
    pairs = a.hint("merge").join(b, keys).withColumn("d", F.sqrt(dx * dx + dy * dy)).withColumnRenamed("f", "frame")
    return pairs.where(F.col("d") <= max_distance)


ORDERED = "(x_um < x_um2 or (x_um = x_um2 and y_um < y_um2))"


def pair_counts(
    points: DataFrame,
    *,
    max_distance: float,
    n_bins: int,
    components: Sequence[str] = ("total", "background"),
    by_frame: bool = True,
    lag: int = 1,
    hot_points: int = HOT_TILE_POINTS,
) -> DataFrame:
    """Distance histograms (sample_id, component, [frame,] bin, n), no zero rows.

    ``total`` pairs frame f with f+lag and keeps exact zeros. ``background`` takes ordered
    pairs within a frame without exact zeros; by symmetry each unordered pair counts twice.
    Without ``by_frame`` the counts are summed over frames inside the join stage.
    """
    lags = [k for k, c in ((lag, "total"), (0, "background")) if c in components]
    spots = collapse(points, FRAME_KEYS)
    pairs = near_pairs(spots, measure(points, hot_points=hot_points), lags=lags, max_distance=max_distance)
    pairs = pairs.where(f"lag <> 0 or (d > 0 and {ORDERED})")
    weight = F.col("w") * F.col("w2") * F.when(F.col("lag") == 0, 2).otherwise(1)
    name = F.when(F.col("lag") == 0, "background").otherwise("total").alias("component")
    keys = [SAMPLE, name, *(["frame"] if by_frame else []), bin_index(F.col("d"), n_bins, max_distance).alias("bin")]
    return pairs.groupBy(*keys).agg(F.sum(weight).alias("n"))


def frame_sizes(points: DataFrame, keys: Sequence[str] = (SAMPLE,)) -> DataFrame:
    """Points with a place per frame."""
    return points.where(has_place()).groupBy(*keys, "frame").agg(F.count("*").alias("n"))


def candidate_counts(points: DataFrame, *, lag: int = 1) -> DataFrame:
    """Candidate pairs and source frames per sample and component, from frame sizes alone."""
    sizes = frame_sizes(points)
    later = sizes.select(SAMPLE, (F.col("frame") - lag).alias("frame"), F.col("n").alias("n2"))
    total = sizes.join(later, FRAME_KEYS).groupBy(SAMPLE).agg(
        F.sum(F.col("n") * F.col("n2")).alias("candidates"), F.count("*").alias("source_frames"))
    background = sizes.groupBy(SAMPLE).agg(F.sum(F.col("n") * F.col("n")).alias("candidates"), F.count("*").alias("source_frames"))
    return total.withColumn("component", F.lit("total")).unionByName(background.withColumn("component", F.lit("background")))


def coincident_pairs(points: DataFrame) -> DataFrame:
    """Ordered same-frame pairs at distance zero, self pairs included: the sum of squared multiplicities."""
    spots = collapse(points, FRAME_KEYS)
    return spots.groupBy(SAMPLE).agg(F.sum(F.col("w") * F.col("w")).alias("zeros"))


def pair_counters(points: DataFrame, *, max_distance: float, lag: int = 1) -> DataFrame:
    """Candidate, zero, retained and source-frame counts per sample and component.

    Candidates come from frame sizes and same-frame zeros from multiplicities; one pair join
    gives the retained pairs and the zeros across frames.
    """
    pairs = near_pairs(collapse(points, FRAME_KEYS), measure(points), lags=[lag, 0], max_distance=max_distance)
    pairs = pairs.where(f"lag <> 0 or (d > 0 and {ORDERED})")
    now = F.col("lag") == 0
    weight = F.col("w") * F.col("w2") * F.when(now, 2).otherwise(1)
    kept = pairs.groupBy(SAMPLE, F.when(now, "background").otherwise("total").alias("component")).agg(
        F.sum(weight).alias("retained"), F.sum(F.when(F.col("d") == 0, weight).otherwise(0)).alias("zeros"))
    same = coincident_pairs(points).select(SAMPLE, F.lit("background").alias("component"), F.col("zeros").alias("own_zeros"))
    out = candidate_counts(points, lag=lag).join(kept, [SAMPLE, "component"], "left").join(same, [SAMPLE, "component"], "left")
    return out.select(
        SAMPLE, "component", "candidates", "source_frames", F.coalesce("own_zeros", "zeros", F.lit(0)).alias("zeros"),
        F.coalesce("retained", F.lit(0)).alias("retained"))


def reached_tiles(axis: str, low: float, high: float, max_distance: float) -> tuple[Column, Column]:
    """The tile of a coordinate, and all tiles from ``low`` to ``high`` that it reaches."""
    edge, reach = 2.0 * max_distance, max_distance * (1 + 1e-9)
    least, most = math.floor(low / edge), math.floor(high / edge)
    if least == most:
        return F.lit(least).cast("long"), F.array(F.lit(least).cast("long"))
    tile = lambda value: F.floor(value / edge).cast("long")
    first, last = F.greatest(tile(F.col(axis) - reach), F.lit(least)), F.least(tile(F.col(axis) + reach), F.lit(most))
    return tile(F.col(axis)), F.sequence(first, last)


COUNTED = "f long, lag int, g int, g2 int, bin int, n long"


def counts_of_tiles(points: DataFrame, layout: Layout, *, max_distance: float, n_bins: int, kinds: int) -> DataFrame:
    """(sample_id, f, lag, g, g2, bin, n) where no frame holds more than ``hot_points``: points move once, and equal ones meet in their tile.

    A group is a tile of ``FRAMES_A_GROUP`` frames with the frame that follows, which bounds it.
    """
    x0, x1, y0, y1 = layout.box
    (gx, across), (gy, down) = reached_tiles("x_um", x0, x1, max_distance), reached_tiles("y_um", y0, y1, max_distance)
    rows = points.where(has_place()).select(
        SAMPLE, F.col("frame").cast("long").alias("f"), F.col("x_um").cast("double").alias("x_um"), F.col("y_um").cast("double").alias("y_um"),
        F.col("g").cast("byte").alias("g"))
    part = F.floor(F.col("f") / FRAMES_A_GROUP).cast("long")
    rows = rows.withColumn("part", F.explode(F.when(F.pmod("f", F.lit(FRAMES_A_GROUP)) == 0, F.array(part, part - 1)).otherwise(F.array(part))))
    rows = rows.withColumn("gx", F.explode(across)).withColumn("gy", F.explode(down))
    rows = rows.withColumn("own", ((F.col("gx") == gx) & (F.col("gy") == gy)).cast("byte"))

    def counted(key, table):
        columns = {c: table.column(c).to_numpy() for c in ("f", "own", "x_um", "y_um", "g")}
        start = key[1].as_py() * FRAMES_A_GROUP
        return dense_pairs.frame_counts(key[0], columns, range(start, start + FRAMES_A_GROUP), n_bins=n_bins, upper=max_distance, kinds=kinds)

    kind = rows.schema[SAMPLE].dataType.simpleString()
    return rows.groupBy(SAMPLE, "part", "gx", "gy").applyInArrow(counted, f"{SAMPLE} {kind}, {COUNTED}")


def counts_of_cut_tiles(points: DataFrame, layout: Layout, *, max_distance: float, n_bins: int, kinds: int) -> DataFrame:
    """``counts_of_tiles`` for frames of any size: equal points are collapsed before, and a full tile is cut."""
    spots = collapse(points, [*FRAME_KEYS, "g"])
    a, b, keys = tiled_sides(spots, layout, lags=[1, 0], max_distance=max_distance)
    sides = a.withColumn("lag", F.lit(-1)).unionByName(b.withColumn("lag", F.col("lag").cast("int")))
    tile = F.hash(*[k for k in keys if k not in (SAMPLE, "f")])
    sides = sides.select(
        SAMPLE, F.floor(F.col("f") / FRAMES_A_GROUP).alias("part"), F.col("f").cast("long").alias("f"), *[F.col(k).cast("long").alias(k) for k in keys if k not in (SAMPLE, "f")],
        tile.alias("tile"), "lag", F.col("x_um").cast("double"), F.col("y_um").cast("double"), F.col("w").cast("long"),
        F.col("g").cast("int").alias("g"))
    inner = ["f", *[k for k in keys if k not in (SAMPLE, "f")]]

    def counted(key, table):
        columns = {c: table.column(c).to_numpy() for c in (*inner, "lag", "x_um", "y_um", "w", "g")}
        return dense_pairs.tile_counts(key[0], columns, inner, n_bins=n_bins, upper=max_distance, kinds=kinds)

    kind = sides.schema[SAMPLE].dataType.simpleString()
    return sides.groupBy(SAMPLE, "part", "tile").applyInArrow(counted, f"{SAMPLE} {kind}, {COUNTED}")


def grouped_pair_counts(
    points: DataFrame,
    *,
    max_distance: float,
    n_bins: int,
    valid_frames: DataFrame | None = None,
    groups: tuple[str, str] = ("On", "Not-on"),
    hot_points: int = HOT_TILE_POINTS,
) -> DataFrame:
    """Per-frame pair counts split by group, from the two sides of each tile.

    Components: ``total`` (both ends in the same group), ``cross`` (ends in different groups,
    ``grp`` is the source), ``background`` (same frame and group, ordered, zeros removed) and
    ``same_cross_background`` (same frame, different groups, counted twice by symmetry).
    With ``valid_frames`` (sample_id, frame) both ends must lie in a valid frame.

    These movies are dense, so pairs never become rows: a tile of a few frames is one group, which numpy counts.
    """
    if valid_frames is not None:
        points = points.join(valid_frames, [SAMPLE, "frame"], "left_semi")
    counts = counts_of_labels(points, ["grp"], groups, max_distance=max_distance, n_bins=n_bins, hot_points=hot_points)
    return named_components(counts, 0, groups, points.schema["frame"].dataType)


def relabeled_pair_counts(
    points: DataFrame,
    other: str,
    *,
    max_distance: float,
    n_bins: int,
    groups: tuple[str, str] = ("On", "Not-on"),
    hot_points: int = HOT_TILE_POINTS,
) -> tuple[DataFrame, DataFrame]:
    """``grouped_pair_counts`` by ``grp`` and by the label ``other`` of the same points; each pair is looked at once for both.

    Points take part whose two labels are of ``groups``. The counts by both labels are written once.
    """
    counts = cut_lineage(counts_of_labels(points, ["grp", other], groups, max_distance=max_distance, n_bins=n_bins, hot_points=hot_points))
    kind = points.schema["frame"].dataType
    return named_components(counts, 0, groups, kind), named_components(counts, 1, groups, kind)


def counts_of_labels(points: DataFrame, labels: Sequence[str], groups: tuple[str, str], *, max_distance: float, n_bins: int, hot_points: int) -> DataFrame:
    """(sample_id, f, lag, g, g2, bin, n): bit k of g and g2 is set where label k, of one or two, is the second of ``groups``."""
    code = F.lit(0)
    for k, label in enumerate(labels):
        points = points.where(F.col(label).isin(*groups))
        code = code + F.when(F.col(label) == groups[0], 0).otherwise(1 << k)
    points = points.withColumn("g", code)
    layout = measure(points, hot_points=hot_points)
    counted = counts_of_tiles if layout.hot is None else counts_of_cut_tiles
    return counted(points, layout, max_distance=max_distance, n_bins=n_bins, kinds=2 ** len(labels))


def named_components(counts: DataFrame, bit: int, groups: tuple[str, str], frame_type) -> DataFrame:
    """(sample_id, component, grp, frame, bin, n) from ``counts_of_labels``, by the label of one bit."""
    side = lambda c: F.shiftright(c, bit).bitwiseAND(F.lit(1)).alias(c)
    counts = counts.select(SAMPLE, "f", "lag", side("g"), side("g2"), "bin", "n")
    same, now = F.col("g") == F.col("g2"), F.col("lag") == 0
    counts = counts.where("lag = 1 or g <= g2")
    name = F.when(now & same, "background").when(now, "same_cross_background").when(same, "total").otherwise("cross")
    weight = F.col("n") * F.when(now & ~same, 2).otherwise(1)
    frame = F.col("f").cast(frame_type).alias("frame")
    grp = F.when(F.col("g") == 0, groups[0]).otherwise(groups[1]).alias("grp")
    return counts.groupBy(SAMPLE, name.alias("component"), grp, frame, "bin").agg(F.sum(weight).alias("n"))


def derived_totals(counts: DataFrame) -> DataFrame:
    """All-point histograms from the grouped components: (sample_id, component, frame, bin, n)."""
    name = F.when(F.col("component").isin("total", "cross"), "all_total").otherwise("all_background")
    return counts.groupBy(SAMPLE, name.alias("component"), "frame", "bin").agg(F.sum("n").alias("n"))


def pool_scopes(counts: DataFrame, scopes: DataFrame) -> DataFrame:
    """Sum per-frame counts into frame ranges; a lag pair must have both ends inside.

    ``scopes`` (scope, start, stop) is a short parameter table. It is turned into
    (frame, scope) rows so the range test becomes an equi-join.
    """
    frames = scopes.select("scope", "stop", F.explode(F.sequence("start", F.col("stop") - 1)).alias("frame"))
    inside = counts.join(broadcast_if_small(frames), "frame").where(
        ~F.col("component").isin("total", "cross", "all_total") | (F.col("frame") < F.col("stop") - 1)
    )
    keys = [c for c in counts.columns if c not in ("frame", "n")]
    return inside.groupBy(*keys, "scope").agg(F.sum("n").alias("n"))
