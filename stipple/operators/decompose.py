"""Background-corrected distance distributions from pair counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipple.functions.columns import or_null, ratio, reasons

# Where the tail fit starts, how far conditional shapes may divide, and the guards.
TAIL_FRACTION = 0.7
EPSILON = 2.220446049250313e-16
MASS_EPSILON = 100 * EPSILON
MIN_TAIL_PAIRS = 100
AREA_GUARD = 0.01
MAIN_GUARD = 0.01
MAIN_UM = 0.1
TAIL_UM = 0.25


def dense_curves(counts: DataFrame, keys: Sequence[str], *, n_bins: int, width: float) -> DataFrame:
    """All bins of every key with total and background counts; absent bins are zero.

    A key has at most 2 x n_bins entries after the first aggregate, so gathering them into
    one row is bounded, and the rows that follow stay partitioned by key.
    """
    by_bin = counts.groupBy(*keys, "bin").agg(
        F.sum(F.when(F.col("component") == "total", F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("component") == "background", F.col("n")).otherwise(0)).alias("b"),
    )
    rows = by_bin.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("t", "b")))).alias("__m")
    )
    grid = rows.select(*keys, "__m", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    at = F.try_element_at("__m", F.col("bin"))
    return grid.select(
        *keys, "bin",
        (F.col("bin") * F.lit(width)).alias("left_um"),
        ((F.col("bin") + 1) * F.lit(width)).alias("right_um"),
        ((F.col("bin") + 0.5) * F.lit(width)).alias("mid_um"),
        F.coalesce(at["t"], F.lit(0)).alias("total_n"),
        F.coalesce(at["b"], F.lit(0)).alias("background_n"),
    )


def _per_key(keys: Sequence[str]):
    w = Window.partitionBy(*keys)
    return lambda expr: F.sum(expr).over(w)


def decompose(dense: DataFrame, keys: Sequence[str], *, n_bins: int) -> DataFrame:
    """Unit-mass total and background, constrained tail fit, exact split of the total.

    beta = sum(b*t)/sum(b*b) over the tail bins, clipped to [0, 1]; the raw value is kept.
    Windows run over one key's bins only, which is a bounded partition.
    """
    start = math.floor(TAIL_FRACTION * n_bins)
    over = _per_key(keys)
    out = dense.withColumn("total_pairs", over(F.col("total_n"))).withColumn(
        "background_pairs", over(F.col("background_n"))
    )
    out = out.withColumn("total", ratio(F.col("total_n"), F.col("total_pairs"))).withColumn(
        "background", ratio(F.col("background_n"), F.col("background_pairs"))
    )
    tail = F.col("bin") >= start
    b, t = F.col("background"), F.col("total")
    out = (
        out.withColumn("fit_num", over(F.when(tail, b * t)))
        .withColumn("fit_den", over(F.when(tail, b * b)))
        .withColumn("beta_raw", ratio(F.col("fit_num"), F.col("fit_den")))
        .withColumn("beta", F.when(F.col("beta_raw").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("beta_raw")))))
        .withColumn("beta_clipped", F.col("beta") != F.col("beta_raw"))
        .withColumn("inter", F.col("beta") * b)
        .withColumn("intra", t - F.col("inter"))
    )
    return out.withColumn("intra_conditional", conditional_shape(F.col("intra"), 1 - F.col("beta")))


def conditional_shape(value: Column, mass: Column) -> Column:
    """Shape of a component: divided by its mass, NULL when the mass is numerically zero."""
    return F.when(F.abs(mass) > MASS_EPSILON, value / mass)


def densities(curves: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_density`` per micrometre, by each bin's own width."""
    width = F.col("right_um") - F.col("left_um")
    return curves.withColumns({f"{c}_density": F.col(c) / width for c in columns})


def guarded_summary(curves: DataFrame, keys: Sequence[str], *, n_bins: int, width: float) -> DataFrame:
    """One row per key: beta, signed area, main/tail mass and ratio, each with its guard.

    A value is NULL when its guard fails and ``status`` says which guard that was.
    """
    start = math.floor(TAIL_FRACTION * n_bins)
    tail_bin = F.col("bin") >= start
    base = curves.groupBy(*keys).agg(
        F.max("total_pairs").alias("total_pairs"),
        F.max("background_pairs").alias("background_pairs"),
        F.sum(F.when(tail_bin, F.col("total_n")).otherwise(0)).alias("total_tail_pairs"),
        F.sum(F.when(tail_bin, F.col("background_n")).otherwise(0)).alias("background_tail_pairs"),
        F.max("beta_raw").alias("beta_raw"),
        F.max("beta").alias("beta"),
        F.sum("intra").alias("signed_area"),
        F.sum(F.when(F.col("mid_um") < MAIN_UM, F.col("intra"))).alias("main_mass"),
        F.sum(F.when((F.col("mid_um") >= MAIN_UM) & (F.col("mid_um") < TAIL_UM), F.col("intra"))).alias("tail_mass"),
        F.sum(F.least(F.col("intra"), F.lit(0.0))).alias("negative"),
    )
    supported = (F.col("total_tail_pairs") >= MIN_TAIL_PAIRS) & (F.col("background_tail_pairs") >= MIN_TAIL_PAIRS)
    shaped = F.col("signed_area").isNotNull() & (F.abs("signed_area") > AREA_GUARD)
    status = (
        F.when(F.col("total_pairs") == 0, "unavailable_empty_total")
        .when(F.col("background_pairs") == 0, "unavailable_empty_background")
        .when(~supported, "unavailable_sparse_tail")
        .when(F.col("beta").isNull(), "unavailable_invalid_distribution")
        .when(~shaped, "unavailable_near_zero_signed_area")
        .otherwise("available_shape")
    )
    base = base.withColumn("tail_supported", supported).withColumn("status", status)
    usable = F.col("tail_supported") & F.col("beta").isNotNull()
    for name in ("beta_raw", "beta", "signed_area", "main_mass", "tail_mass"):
        base = base.withColumn(name, F.when(usable, or_null(F.col(name))))
    main_ok = F.col("main_mass") > MAIN_GUARD
    return base.withColumn("negative_mass", F.when(usable, -F.col("negative"))).withColumn(
        "tail_main_ratio", F.when(main_ok, F.col("tail_mass") / F.col("main_mass"))
    ).withColumn(
        "ratio_status",
        F.when(main_ok, "available")
        .when(~F.col("tail_supported"), "unavailable_sparse_tail")
        .when(F.col("beta").isNull(), "unavailable_invalid_distribution")
        .otherwise("unavailable_main_mass_not_above_guard"),
    ).drop("negative")


def with_shape(curves: DataFrame, keys: Sequence[str], *, n_bins: int) -> DataFrame:
    """Add the curve's status, its area shape and its peak shape, all over one key's bins.

    The same guards as ``guarded_summary``, as windows, so the pairs are not read twice.
    """
    start = math.floor(TAIL_FRACTION * n_bins)
    w, over = Window.partitionBy(*keys), _per_key(keys)
    tail = lambda c: over(F.when(F.col("bin") >= start, F.col(c)).otherwise(0))
    supported = (tail("total_n") >= MIN_TAIL_PAIRS) & (tail("background_n") >= MIN_TAIL_PAIRS)
    area = over(F.col("intra"))
    status = (
        F.when(F.col("total_pairs") == 0, "unavailable_empty_total")
        .when(F.col("background_pairs") == 0, "unavailable_empty_background")
        .when(~supported, "unavailable_sparse_tail")
        .when(F.col("beta").isNull(), "unavailable_invalid_distribution")
        .when(~F.coalesce(F.abs(area) > AREA_GUARD, F.lit(False)), "unavailable_near_zero_signed_area")
        .otherwise("available_shape")
    )
    ok, top = F.col("status") == "available_shape", F.max("intra").over(w)
    return curves.withColumn("status", status).withColumns({
        "shape": F.when(ok, F.col("intra") / area), "peak": F.when(ok & (top > 0), F.col("intra") / top)})


def field_status(summary: DataFrame) -> DataFrame:
    """Availability of each curve field per key, long form (keys, field, field_status)."""
    supported, fitted = F.col("tail_supported"), F.col("beta").isNotNull()
    derived = F.when(supported & fitted, F.lit("available")).when(
        ~supported, F.lit("unavailable_sparse_tail")
    ).otherwise("unavailable_invalid_distribution")
    whole = lambda n, name: F.when(F.col(n) > 0, "available").otherwise(f"unavailable_empty_{name}")
    per_field = {
        "total": whole("total_pairs", "total"), "background": whole("background_pairs", "background"),
        "inter": derived, "intra": derived, "shape": F.col("status"),
    }
    fields = F.array(*[
        F.struct(F.lit(n).alias("field"), c.alias("field_status")) for n, c in per_field.items()
    ])
    return summary.withColumn("__f", F.explode(fields)).select("*", "__f.field", "__f.field_status").drop("__f")


def tail_diagnostics(curves: DataFrame, keys: Sequence[str], *, n_bins: int) -> DataFrame:
    """How alike the two tails are: L1 distance and cosine of the unit-mass tails, largest residual."""
    start = math.floor(TAIL_FRACTION * n_bins)
    over = _per_key(keys)
    tail = curves.where(F.col("bin") >= start)
    tail = tail.withColumn("__t", ratio(F.col("total"), over(F.col("total")))).withColumn(
        "__b", ratio(F.col("background"), over(F.col("background")))
    )
    t, b = F.col("total"), F.col("background")
    return tail.groupBy(*keys).agg(
        F.sum(F.abs(F.col("__t") - F.col("__b"))).alias("tail_l1"),
        ratio(F.sum(t * b), F.sqrt(F.sum(t * t) * F.sum(b * b))).alias("tail_cosine"),
        F.max(F.abs("intra")).alias("max_abs_residual"),
        F.sum(F.col("intra") * F.col("intra")).alias("residual_ss"),
    )


def exact_signs(curves: DataFrame, keys: Sequence[str], *, n_bins: int) -> DataFrame:
    """Add ``above`` (the raw beta is above 1) and ``negative`` (the intra part is below 0), NULL without a fit, from whole numbers.

    The doubles of ``decompose`` carry the order of their sums: where a part is exactly zero, their sign is chance. Products that
    don't fit 38 digits (counts of a bin beyond about 10^12) leave the sign to the doubles.
    """
    over, tail = Window.partitionBy(*keys), F.col("bin") >= math.floor(TAIL_FRACTION * n_bins)
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    times = F.try_multiply
    t, b, tp, bp = (whole(c) for c in ("total_n", "background_n", "total_pairs", "background_pairs"))
    sums = {n: F.try_sum(F.when(tail, times(x, b))).over(over) for n, x in (("__tb", t), ("__bb", b))}
    out = curves.withColumns(sums)
    one, raw = times(F.col("__bb"), tp), times(F.col("__tb"), bp)
    out = out.withColumn("above", F.when(F.col("beta").isNotNull(), F.coalesce(raw > one, F.col("beta_raw") > 1)))
    below = F.when(F.col("above"), times(t, bp) < times(b, tp)).otherwise(times(t, F.col("__bb")) < times(b, F.col("__tb")))
    return out.withColumn("negative", F.when(F.col("intra").isNotNull(), F.coalesce(below, F.col("intra") < 0))).drop("__tb", "__bb")


def cell_quality(points: DataFrame, candidates: DataFrame, curves: DataFrame, *, n_bins: int) -> DataFrame:
    """Per-sample checks with the list of raised flags.

    ``candidates`` are the candidate counts; retained pairs are those of the curves, so the
    pair join runs once.
    """
    start = math.floor(TAIL_FRACTION * n_bins)
    per_coordinate = points.groupBy("sample_id", "frame", "x_um", "y_um").agg(F.count("*").alias("w"))
    per_frame = per_coordinate.groupBy("sample_id", "frame").agg(
        F.sum("w").alias("rows"), F.sum(F.col("w") - 1).alias("dups"), F.sum(F.col("w") * F.col("w")).alias("coincident")
    )
    shape = per_frame.groupBy("sample_id").agg(
        F.sum("rows").alias("localizations"), F.count("*").alias("frames"),
        (F.max("frame") - F.min("frame") + 1 - F.count("*")).alias("missing_frames"),
        F.sum("dups").alias("duplicate_rows"), F.sum("coincident").alias("background_zeros"),
    )
    wide = candidates.groupBy("sample_id").agg(*[
        F.max(F.when(F.col("component") == c, F.col("candidates"))).alias(f"{c}_candidates") for c in ("total", "background")
    ])
    fit = exact_signs(curves, ["sample_id"], n_bins=n_bins).groupBy("sample_id").agg(
        F.max("total_pairs").alias("total_retained"), F.max("background_pairs").alias("background_retained"),
        F.max(F.coalesce(F.col("above"), F.lit(False))).alias("beta_clipped"),
        F.count_if("negative").alias("negative_intra_bins"),
        (-F.sum(F.least(F.col("intra"), F.lit(0.0)))).alias("negative_intra_mass"),
        F.max(F.abs(F.col("total") - F.col("inter") - F.col("intra"))).alias("reconstruction_error"),
        F.sum(F.when(F.col("bin") >= start, F.col("background_n"))).alias("background_tail"),
    )
    joined = shape.join(wide, "sample_id", "left").join(fit, "sample_id", "left")
    joined = joined.withColumn(
        "extra_zeros", F.greatest(F.lit(0), F.col("background_zeros") - F.col("localizations"))
    )
    flags = reasons([
        ("beta_clipped", F.col("beta_clipped")),
        ("negative_intra_bins", F.col("negative_intra_bins") > 0),
        ("missing_frames", F.col("missing_frames") > 0),
        ("coincident_same_frame_detections_removed", F.col("extra_zeros") > 0),
        ("sparse_inter_tail", F.col("background_tail") < MIN_TAIL_PAIRS),
        ("reconstruction_error", F.col("reconstruction_error") > 1e-12),
    ])
    return joined.withColumn("flags", F.array_join(flags, ";")).withColumn(
        "status", F.when(F.size(flags) == 0, "pass").otherwise("pass_with_warnings")
    ).withColumn("total_retained_fraction", F.col("total_retained") / F.greatest("total_candidates", F.lit(1))
    ).withColumn("background_retained_fraction", F.col("background_retained") / F.greatest("background_candidates", F.lit(1)))
