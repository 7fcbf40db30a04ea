"""Pixel movies and sparse masks: support windows, areas, overlap, thresholds, display limits.

A mask is a table of (block, y, x): a row exists where the mask is set. ``by`` names the
columns that separate samples. An image has a fixed number of pixels, so any group of
(sample, frame) or (sample, block) is bounded by the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipple.functions.columns import ratio, reasons, remap_16bit
from stipple.operators.skew import exact_quantiles, with_totals

PX_UM = 0.117  # Fixed value: pixel pitch in micrometres.
MAD_SCALE = 0.6744897501960817  # Fixed value: normal consistency factor of the MAD.
CDF_BINS = 65_536


def contract_check(pixels: DataFrame, *, frames: int, height: int, width: int, low: float, high: float, by: Sequence[str] = ()) -> DataFrame:
    """Does the movie have the declared frames, extent and value range? One row per sample."""
    out = pixels.groupBy(*by).agg(
        F.countDistinct("frame").alias("frames"), F.max("y").alias("max_y"), F.max("x").alias("max_x"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    ok = (F.col("frames") == frames) & (F.col("max_y") < height) & (F.col("max_x") < width) & (
        F.col("min_value") >= low) & (F.col("max_value") <= high)
    return out.withColumn("meets_contract", ok)


def metadata_expectations(*, height: int, width: int, pixel_nm: float, block_frames: int, support_minimum: int) -> list:
    """What the saved metadata of a mask must say: shape and axes, units, window length, thresholds and connectivity."""
    return [
        ("shape", (F.col("height") == height) & (F.col("width") == width) & (F.col("axes") == "TYX")),
        ("pixel_size", F.col("pixel_nm") == pixel_nm),
        ("block_length", F.col("block_frames") == block_frames),
        ("support_minimum", F.col("support_minimum") == support_minimum),
        ("connectivity", (F.col("foreground_connectivity") == 8) & (F.col("background_connectivity") == 4)),
    ]


def block_validity(frame_map: DataFrame, *, window: int, by: Sequence[str] = ()) -> DataFrame:
    """Completeness of each support window: an incomplete one is unknown, never empty."""
    out = frame_map.groupBy(*by, "block").agg(
        F.count("*").alias("expected"), F.count_if("participating").alias("seen"), F.min("frame").alias("frame_start"))
    incomplete = (F.col("expected") != window) | (F.col("seen") < F.col("expected"))
    reason = F.when(F.col("seen") == 0, "no_participating_frames").when(incomplete, "incomplete_support_block").otherwise("")
    return out.withColumn("reason", reason).withColumn("valid", F.col("reason") == "")


def contract_violations(frame_map: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Frames mapped to several blocks, repeated frames and negative ids, per sample."""
    per_frame = frame_map.groupBy(*by, "frame").agg(F.count("*").alias("n"), F.countDistinct("block").alias("blocks"))
    return per_frame.groupBy(*by).agg(
        F.count("*").alias("frames"), F.count_if(F.col("n") > 1).alias("repeated"),
        F.count_if(F.col("blocks") > 1).alias("several_blocks"), F.count_if(F.col("frame") < 0).alias("negative"))


def support_counts(foreground: DataFrame, frame_map: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """In how many frames of its window each pixel is foreground (tumbling windows of the frame map).

    Repeated rows of a pixel in a frame count once. A frame that the map doesn't list has no window.
    """
    placed = foreground.join(frame_map.select(*by, "frame", "block"), [*by, "frame"])
    return placed.groupBy(*by, "block", "y", "x").agg(F.countDistinct("frame").alias("support"))


def support_mask(counts: DataFrame, blocks: DataFrame, *, minimum: int, by: Sequence[str] = ()) -> DataFrame:
    """Pixels with enough support in valid windows; invalid windows contribute none."""
    return counts.where(F.col("support") >= minimum).join(
        blocks.where("valid").select(*by, "block"), [*by, "block"], "left_semi").select(*by, "block", "y", "x")


def clip_to(mask: DataFrame, region: DataFrame, *, on: Sequence[str] = ("y", "x")) -> DataFrame:
    """Mask pixels inside a region table."""
    return mask.join(region.select(*on), list(on), "left_semi")


def mask_areas(mask: DataFrame, blocks: DataFrame, region: DataFrame, *, by: Sequence[str] = (), px_um: float = PX_UM) -> DataFrame:
    """Area per window, whole image and region: valid but empty is 0, invalid is NULL."""
    inside = region.select("y", "x", F.lit(1).alias("__in"))
    n = mask.join(inside, ["y", "x"], "left").groupBy(*by, "block").agg(
        F.count("*").alias("full_n"), F.count("__in").alias("roi_n"))
    out = blocks.join(n, [*by, "block"], "left")
    known = lambda c: F.when(F.col("valid"), F.coalesce(F.col(c), F.lit(0)))
    return out.select(
        *by, "block", "frame_start", "seen", "valid", "reason", known("full_n").alias("full_px"), known("roi_n").alias("roi_px"),
        (known("full_n") * px_um**2).alias("full_um2"), (known("roi_n") * px_um**2).alias("roi_um2"))


def area_by_frame(areas: DataFrame, frame_map: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """The area of each frame is the area of its window."""
    return frame_map.select(*by, "frame", "block").join(
        areas.select(*by, "block", "valid", "roi_um2", "full_um2"), [*by, "block"], "left")


def area_summary(by_frame: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """First, mean, median, min and max area per scope; NULL unless every window is valid.

    The frames of a sample are bounded, so the exact median per sample is too.
    """
    all_valid = F.bool_and(F.coalesce("valid", F.lit(False)))
    long = by_frame.unpivot([*by, "frame", "valid"], ["full_um2", "roi_um2"], "scope", "area")
    whole = {
        "mean": F.avg("area"), "median": F.percentile("area", F.lit(0.5)), "min": F.min("area"), "max": F.max("area")}
    out = long.groupBy(*by, "scope").agg(
        F.min_by("area", "frame").alias("first"), all_valid.alias("__ok"), F.count_if("valid").alias("valid_frames"),
        F.count("*").alias("expected_frames"), *[v.alias(k) for k, v in whole.items()])
    return out.select(
        *by, "scope", "first", *[F.when(F.col("__ok"), F.col(k)).alias(k) for k in whole], "valid_frames", "expected_frames",
        F.when(F.col("__ok"), "available").otherwise("unavailable_missing_mask_blocks").alias("status"))


def time_weighted_area(areas: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Mean area weighted by window duration, and the first window's area.

    A NULL area makes the mean NULL: a missing window is not skipped.
    """
    complete = F.count("roi_um2") == F.count("*")
    return areas.groupBy(*by).agg(
        F.min_by("roi_um2", "frame_start").alias("first_um2"),
        F.when(complete, F.sum(F.col("roi_um2") * F.col("seen")) / F.sum("seen")).alias("mean_um2"),
        F.count("*").alias("blocks"), F.count("roi_um2").alias("known_blocks"))


def overlap(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixel sets compared per key: sizes, intersection, union, added, removed, IoU, Dice, change.

    Both tables hold (keys, y, x). Two empty sets cannot appear here; they agree by definition.
    """
    a = old.select(*keys, "y", "x", F.lit(1).alias("__a"))
    b = new.select(*keys, "y", "x", F.lit(1).alias("__b"))
    out = a.join(b, [*keys, "y", "x"], "full_outer").groupBy(*keys).agg(
        F.count("__a").alias("old_px"), F.count("__b").alias("new_px"),
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("intersection"), F.count("*").alias("union"))
    return out.withColumns({
        "added": F.col("new_px") - F.col("intersection"), "removed": F.col("old_px") - F.col("intersection"),
        "delta_px": F.col("new_px") - F.col("old_px"), "delta_pct": 100.0 * (ratio(F.col("new_px"), F.col("old_px")) - 1),
        "iou": F.col("intersection") / F.col("union"), "dice": 2 * F.col("intersection") / (F.col("old_px") + F.col("new_px"))})


def adjacent_overlap(mask: DataFrame, blocks: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """IoU of each window with the next one; 1 where both are empty."""
    later = mask.select(*by, (F.col("block") - 1).alias("block"), "y", "x")
    o = overlap(mask, later, [*by, "block"]).select(*by, "block", "iou")
    w = Window.partitionBy(*by).orderBy("block") if by else Window.partitionBy(F.lit(1)).orderBy("block")
    pairs = blocks.select(*by, "block", F.lead("frame_start").over(w).alias("frame_after")).where("frame_after is not null")
    return pairs.join(o, [*by, "block"], "left").select(
        *by, F.col("block").alias("block_before"), (F.col("block") + 1).alias("block_after"), "frame_after",
        F.coalesce("iou", F.lit(1.0)).alias("iou"))


def bright_coverage(
    pixels: DataFrame, limits: DataFrame, region: DataFrame, masks: DataFrame, *, methods: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """How much of the bright region each method's mask covers.

    ``pixels`` has (frame, block, y, x, value), ``limits`` a brightness limit per frame and
    ``masks`` (method, block, y, x).
    """
    bright = pixels.join(limits, [*by, "frame"]).where("value > limit").join(region.select("y", "x"), ["y", "x"], "left_semi")
    each = bright.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    hit = each.join(masks.withColumn("__m", F.lit(1)), [*by, "method", "block", "y", "x"], "left")
    out = hit.groupBy(*by, "method", "frame", "block").agg(F.count("*").alias("bright_px"), F.count("__m").alias("covered_px"))
    return out.withColumn("coverage_pct", F.col("covered_px") * 100.0 / F.col("bright_px"))


def stage_areas(stages: DataFrame, region: DataFrame, *, by: Sequence[str] = (), px_um: float = PX_UM) -> DataFrame:
    """Pixels and area per mask-building stage (method, stage, block), whole image and region."""
    inside = region.select("y", "x", F.lit(1).alias("__in"))
    n = stages.join(inside, ["y", "x"], "left").groupBy(*by, "method", "stage", "block").agg(
        F.count("*").alias("full"), F.count("__in").alias("roi"))
    return n.unpivot([*by, "method", "stage", "block"], ["full", "roi"], "scope", "px").withColumn("um2", F.col("px") * px_um**2)


def mean_image(pixels: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Arithmetic mean of each pixel over its frames, zeros included."""
    return pixels.groupBy(*by, "y", "x").agg(F.avg("value").alias("mean"), F.count("*").alias("frames"))


def robust_threshold(pixels: DataFrame, *, k: float, min_pixels: int, by: Sequence[str] = ()) -> DataFrame:
    """Median + k * MAD / 0.67449 per frame over positive pixels; NULL below the pixel minimum or without spread."""
    keys = [*by, "frame"]
    v = pixels.where("value > 0")
    med = v.groupBy(*keys).agg(F.percentile("value", F.lit(0.5)).alias("median"), F.count("*").alias("positive_px"))
    mad = v.join(med, keys).groupBy(*keys, "median", "positive_px").agg(
        F.percentile(F.abs(F.col("value") - F.col("median")), F.lit(0.5)).alias("mad"))
    usable = (F.col("positive_px") >= min_pixels) & (F.col("mad") > 0)
    return mad.withColumn("threshold", F.when(usable, F.col("median") + F.lit(float(k)) * F.col("mad") / F.lit(MAD_SCALE)))


def strong_pixels(pixels: DataFrame, thresholds: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    return pixels.join(thresholds.select(*by, "frame", "threshold"), [*by, "frame"]).where("value > threshold").select(*by, "frame", "y", "x")


def contrast_limits(pixels: DataFrame, *, low: float = 0.01, high: float | None = 0.99, by: Sequence[str] = ()) -> DataFrame:
    """Stretch limits per frame from a quantized cumulative histogram.

    The low limit is the first bin whose cumulative share exceeds ``low``, the high limit the
    first that reaches ``high`` (None leaves the top open). Equal limits fall back to the full range.
    """
    keys = [*by, "frame"]
    span = pixels.groupBy(*keys).agg(F.min("value").alias("lo0"), F.max("value").alias("hi0"), F.count("*").alias("total"))
    p = pixels.join(span, keys)
    delta = F.lit(1.0) / (F.col("hi0") - F.col("lo0"))
    raw = F.when(F.col("hi0") == F.col("lo0"), F.col("value")).otherwise(delta * F.col("value") - F.col("lo0") * delta)
    z = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    hist = p.groupBy(*keys, "lo0", "hi0", "total", F.floor(z * (CDF_BINS - 1) + 0.5).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cdf = hist.withColumn("cdf", F.sum("n").over(upto) / F.col("total"))
    top = F.min(F.when(F.col("cdf") >= high, F.col("bin"))) if high is not None else F.lit(CDF_BINS - 1)
    out = cdf.groupBy(*keys, "lo0", "hi0").agg(F.min(F.when(F.col("cdf") > low, F.col("bin"))).alias("low_bin"), top.alias("high_bin"))
    flat = F.col("low_bin") == F.col("high_bin")
    out = out.withColumns({
        "flat_fallback": flat, "low_unit": F.when(flat, 0.0).otherwise(F.col("low_bin") / (CDF_BINS - 1)),
        "high_unit": F.when(flat, 1.0).otherwise(F.col("high_bin") / (CDF_BINS - 1))})
    width = F.col("hi0") - F.col("lo0")
    return out.withColumns({"low_value": F.col("lo0") + F.col("low_unit") * width, "high_value": F.col("lo0") + F.col("high_unit") * width})


def remap(pixels: DataFrame, *, low: float, high: float) -> DataFrame:
    """Fixed linear contrast remap to 16 bit."""
    return pixels.withColumn("mapped", remap_16bit(F.col("value"), F.lit(low), F.lit(high)))


def display_window(pixels: DataFrame, region: DataFrame, *, probs: tuple[float, float], fixed: tuple[float, float], by: Sequence[str] = ()) -> DataFrame:
    """One display window per sample from pooled region pixels, zeros excluded.

    No signal falls back to the fixed limits, equal limits are widened by one on each side.
    """
    keys = [*by] or ["__all"]
    base = pixels if by else pixels.withColumn("__all", F.lit(0))
    inside = base.join(region.select("y", "x"), ["y", "x"], "left_semi")
    signal = inside.where("value <> 0 and not isnan(value)")
    q = exact_quantiles(signal, keys, "value", list(probs))
    limits = q.groupBy(*keys).agg(
        F.max(F.when(F.col("prob") == probs[0], F.col("quantile"))).alias("lo"),
        F.max(F.when(F.col("prob") == probs[1], F.col("quantile"))).alias("hi"))
    counts = inside.groupBy(*keys).agg(F.count_if((F.col("value") != 0) & ~F.isnan("value")).alias("signal_px"))
    out = counts.join(limits, keys, "left")
    centre = F.least(F.lit(65535.0), F.greatest(F.lit(0.0), F.col("lo")))
    flat = F.col("lo") >= F.col("hi")
    empty = F.col("lo").isNull()
    return out.select(
        *by, "signal_px",
        F.when(empty, fixed[0]).when(flat, F.greatest(F.lit(0.0), centre - 1)).otherwise(F.col("lo")).alias("low"),
        F.when(empty, fixed[1]).when(flat, F.least(F.lit(65535.0), centre + 1)).otherwise(F.col("hi")).alias("high"),
        F.when(empty, "no_finite_nonzero_ROI_pixels").when(flat, "degenerate_percentile_interval").alias("fallback"))


def strip_profile(pixels: DataFrame, *, across: str, low: int, high: int, by: Sequence[str] = ()) -> DataFrame:
    """Kymograph rows: mean over a strip of ``across`` per frame and position on the other axis."""
    along = "x" if across == "y" else "y"
    return pixels.where(F.col(across).between(low, high)).groupBy(*by, "frame", along).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def crop_box(region: DataFrame, *, height: int, width: int, margin: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Region extent with a margin, clipped to the image; the upper ends are exclusive."""
    return region.groupBy(*by).agg(
        F.greatest(F.lit(0), F.min("x") - margin).alias("x0"), F.greatest(F.lit(0), F.min("y") - margin).alias("y0"),
        F.least(F.lit(width), F.max("x") + margin + 1).alias("x1"), F.least(F.lit(height), F.max("y") + margin + 1).alias("y1"))


def support_contract(
    frame_map: DataFrame, participants: DataFrame, requested: DataFrame, declared: DataFrame, *, by: Sequence[str] = ()
) -> DataFrame:
    """The verdict on each declared block (by, block): its frames against the map and the request, its validity and reason.

    ``frame_map``, ``participants`` and ``requested`` hold (by, block, frame), ``declared`` (by, block, valid, reason). A block without all
    its requested frames, or without any, is invalid whatever was declared, and an invalid block always has a reason.
    """
    keys = [*by, "block", "frame"]
    frames = [*by, "frame"]
    seen = with_totals(participants.select(*keys), frames, uses=F.count("*"))
    asked = with_totals(requested.select(*keys), frames, requests=F.count("*"))
    mapped = frame_map.select(*keys).distinct().withColumn("mapped", F.lit(True))
    one = seen.groupBy(*keys).agg(F.max("uses").alias("uses")).join(mapped, keys, "left").join(
        asked.groupBy(*keys).agg(F.max("requests").alias("requests")), keys, "full")
    counted = one.groupBy(*by, "block").agg(
        F.count("uses").alias("present"), F.count_if(F.col("uses").isNull()).alias("missing"), F.count_if(F.col("requests").isNull()).alias("extra"),
        F.count_if(F.col("uses") > 1).alias("repeated"), F.count_if(F.col("uses").isNotNull() & F.col("mapped").isNull()).alias("unmapped"),
        F.count_if(F.col("requests") > 1).alias("overlapping"))
    n = {c: F.coalesce(c, F.lit(0)) for c in ("present", "missing", "extra", "repeated", "unmapped", "overlapping")}
    out = declared.join(counted, [*by, "block"], "left").withColumns(n)
    incomplete = (F.col("missing") > 0) | (F.col("extra") > 0) | (F.col("present") == 0)
    valid = F.coalesce("valid", F.lit(False)) & ~incomplete
    given = F.nullif(F.trim("reason"), F.lit(""))
    reason = F.when(valid, F.coalesce(given, F.lit(""))).otherwise(
        F.coalesce(given, F.when(incomplete, "incomplete_support_block").otherwise("invalid_support_block")))
    broken = reasons([("frame_repeated", F.col("repeated") > 0), ("map_disagrees", F.col("unmapped") > 0),
                      ("windows_overlap", F.col("overlapping") > 0), ("validity_not_declared", F.col("valid").isNull())])
    return out.select(*by, "block", *n, valid.alias("valid"), reason.alias("reason"), F.array_join(broken, ";").alias("message"))
