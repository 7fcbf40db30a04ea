"""Operators on curves held as one row per bin. Every window spans one curve's bins only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipple.operators.decompose import MASS_EPSILON
from stipple.operators.skew import with_totals

WINDOW_UM = 0.3  # Fixed value: the near window of the positive-part summary.
SHAPE_UM = 0.5  # Fixed value: the window of the shape comparison.


def area_normalized(
    curves: DataFrame, keys: Sequence[str], value: str, width: float, *, min_area: float = MASS_EPSILON
) -> DataFrame:
    """Signed curve divided by its own signed area, as ``area_value``; NULL when the area is numerically zero."""
    area = F.sum(F.col(value) * width).over(Window.partitionBy(*keys))
    return curves.withColumn("area_value", F.when(F.abs(area) > min_area, F.col(value) / area))


def peak_normalized(curves: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Curve divided by its positive maximum, as ``peak_value``; NULL when there is none."""
    w = Window.partitionBy(*keys)
    top = F.max(value).over(w)
    return curves.withColumn("peak_value", F.when(top > 0, F.col(value) / top))


def positive_summary(curves: DataFrame, keys: Sequence[str], value: str, *, window_um: float = WINDOW_UM) -> DataFrame:
    """Peak, mass, near mass, weighted mean and interpolated weighted median of the positive part.

    Needs left_um, right_um, mid_um and bin. Where there is no positive mass the
    location values are NULL and the peak bin is -1.
    """
    keys = list(keys)
    width = F.col("right_um") - F.col("left_um")
    p = curves.select(*keys, "bin", "left_um", "right_um", "mid_um", F.greatest(F.col(value), F.lit(0.0)).alias("p"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    p = p.withColumn("cum", F.sum("p").over(upto)).withColumn("half", F.sum("p").over(whole) * 0.5)
    overlap = F.greatest(F.lit(0.0), F.least(F.col("right_um"), F.lit(window_um)) - F.greatest(F.col("left_um"), F.lit(0.0)))
    reached = F.when((F.col("half") > 0) & (F.col("cum") >= F.col("half")), F.col("bin"))
    at = F.col("left_um") + (F.col("half") - (F.col("cum") - F.col("p"))) / F.col("p") * width
    best = F.struct((F.col("p") / width).alias("density"), (-F.col("bin")).alias("order"))
    out = p.groupBy(*keys).agg(
        F.max_by(F.struct("bin", "mid_um", "p", (F.col("p") / width).alias("density")), best).alias("top"),
        F.sum("p").alias("positive_mass"),
        F.sum(F.col("p") * overlap / width).alias("near_mass"),
        F.sum(F.col("p") * F.col("mid_um")).alias("moment"),
        F.min_by(at, reached).alias("median_um"),
    )
    some = F.col("positive_mass") > 0
    return out.select(
        *keys,
        F.when(some, F.col("top.bin")).otherwise(-1).alias("peak_bin"),
        F.when(some, F.col("top.mid_um")).alias("peak_um"),
        F.when(some, F.col("top.p")).alias("peak_mass"),
        F.when(some, F.col("top.density")).alias("peak_density"),
        "positive_mass", "near_mass",
        F.when(some, F.col("moment") / F.col("positive_mass")).alias("mean_um"),
        F.when(some, F.col("median_um")).alias("median_um"),
    )


def shape_summary_nm(curves: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mode, mean and median of a displayed curve, in nanometres."""
    s = positive_summary(curves, keys, value)
    return s.select(*keys, (F.col("peak_um") * 1000).alias("mode_nm"), (F.col("mean_um") * 1000).alias("mean_nm"),
                    (F.col("median_um") * 1000).alias("median_nm"))


def leave_one_out_similarity(
    curves: DataFrame, group: Sequence[str], member: str, value: str, *, upto_um: float = SHAPE_UM
) -> DataFrame:
    """Pearson r and RMSE of each member's curve against the mean of the other members.

    ``value`` may be NULL for members without a valid curve; they are ignored as others and
    give NULL results for themselves.
    """
    group = list(group)
    # the mean of the others is (sum - own) / (count - 1); sums are combined map-side, then joined
    near = curves.where(F.col("mid_um") <= upto_um)
    near = with_totals(near, [*group, "bin"], __s=F.sum(value), __c=F.count(value))
    others = F.col("__c") - F.when(F.col(value).isNotNull(), 1).otherwise(0)
    rest = F.col("__s") - F.coalesce(F.col(value), F.lit(0.0))
    near = near.withColumn("ref", F.when(others > 0, rest / others))
    both = F.col(value).isNotNull() & F.col("ref").isNotNull()
    v, r = F.when(both, F.col(value)), F.when(both, F.col("ref"))
    varies = (F.stddev_pop(v) > 0) & (F.stddev_pop(r) > 0)
    return near.groupBy(*group, member).agg(
        F.count(v).alias("bins"),
        F.when((F.count(v) >= 2) & varies, F.corr(v, r)).alias("pearson_r"),
        F.sqrt(F.avg((v - r) * (v - r))).alias("rmse"),
    )


def group_difference(
    curves: DataFrame, keys: Sequence[str], value: str, *, groups: tuple[str, str] = ("On", "Not-on"), **windows
) -> DataFrame:
    """Compare two groups of one curve table by the same measures, in one pass over the bins."""
    side = lambda g: F.max(F.when(F.col("grp") == g, F.col(value)))
    wide = curves.where(F.col("grp").isin(*groups)).groupBy(*keys, "bin", "mid_um").agg(
        side(groups[0]).alias("va"), side(groups[1]).alias("vb"), F.countDistinct("grp").alias("sides")).where("sides = 2")
    return difference_measures(wide.withColumn("d", F.col("va") - F.col("vb")), keys, **windows)


def compare_curves(
    a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, **windows
) -> DataFrame:
    """Compare two curve tables that share keys and bins; both need mid_um."""
    left = a.select(*keys, "bin", "mid_um", F.col(value).alias("va"))
    right = b.select(*keys, "bin", F.col(value).alias("vb"))
    return difference_measures(left.join(right, [*keys, "bin"]).withColumn("d", F.col("va") - F.col("vb")), keys, **windows)


def difference_measures(
    d: DataFrame, keys: Sequence[str], *, width: float, main_um: float = 0.1, tail_um: float = 0.25
) -> DataFrame:
    """Largest and integrated absolute difference and window differences of column ``d`` per key.

    A key is available only if every one of its bins has a difference.
    """
    keys = list(keys)
    near = (F.col("mid_um") < main_um)
    far = (F.col("mid_um") >= main_um) & (F.col("mid_um") < tail_um)
    order = F.struct(F.abs("d").alias("size"), (-F.col("bin")).alias("order"))
    out = d.groupBy(*keys).agg(
        F.bool_and(F.col("d").isNotNull()).alias("available"),
        F.max(F.abs("d")).alias("max_abs_difference"),
        F.max_by("mid_um", F.when(F.col("d").isNotNull(), order)).alias("max_abs_difference_um"),
        F.sum(F.abs("d") * width).alias("integrated_abs_difference"),
        F.sum(F.when(near, F.col("d") * width).otherwise(0.0)).alias("main_difference"),
        F.sum(F.when(far, F.col("d") * width).otherwise(0.0)).alias("tail_difference"),
    )
    values = [c for c in out.columns if c not in (*keys, "available")]
    return out.select(*keys, "available", *[F.when(F.col("available"), F.col(c)).alias(c) for c in values])
