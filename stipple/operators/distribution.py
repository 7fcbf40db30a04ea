"""Histograms, maps and descriptions of point attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipple.functions.columns import bin_index, finite
from stipple.operators.skew import exact_quantiles
from stipple.session import cut_lineage

ROWS_A_TASK = 1_000_000  # rows that one task of a histogram with its own edges holds


def histogram(df: DataFrame, keys: Sequence[str], value: str, *, lower: float, upper: float, n_bins: int) -> DataFrame:
    """Counts per equal bin of [lower, upper], occupied bins only."""
    inside = df.where(finite(F.col(value)) & F.col(value).between(lower, upper))
    return inside.groupBy(*keys, bin_index(F.col(value), n_bins, upper, lower).alias("bin")).agg(F.count("*").alias("n"))


def range_accounting(df: DataFrame, keys: Sequence[str], value: str, *, lower: float, upper: float) -> DataFrame:
    """total = displayed + below + above + nonfinite, per key, with the verdict."""
    ok, v = finite(F.col(value)), F.col(value)
    out = df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(ok & v.between(lower, upper)).alias("displayed"),
        F.count_if(ok & (v < lower)).alias("below"), F.count_if(ok & (v > upper)).alias("above"), F.count_if(~ok).alias("nonfinite"))
    return out.withColumn("balanced", F.col("total") == F.col("displayed") + F.col("below") + F.col("above") + F.col("nonfinite"))


def data_edge_histogram(df: DataFrame, keys: Sequence[str], group: str, value: str, *, n_bins: int) -> DataFrame:
    """Histogram whose upper edge is max(1, largest value) of the key, shared by its groups.

    Rows are dealt by key over as many tasks as their number asks for, and meet the edges there without a sort.
    """
    good = df.where(finite(F.col(value)) & (F.col(value) >= 0))
    tops = cut_lineage(good.groupBy(*keys).agg(F.greatest(F.lit(1.0), F.max(value)).alias("upper"), F.count("*").alias("__n")))
    rows = tops.agg(F.sum("__n")).first()[0] or 0
    tasks = max(rows // ROWS_A_TASK + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    good = good.select(*keys, group, value).repartition(tasks, *keys)
    tops = tops.drop("__n").hint("shuffle_hash")
    width = F.col("upper") / n_bins
    guess = F.least(F.floor(F.col(value) / width).cast("int"), F.lit(n_bins - 1))
    bin_ = F.when(F.col(value) < guess * width, guess - 1).when(
        (guess < n_bins - 1) & (F.col(value) >= (guess + 1) * width), guess + 1).otherwise(guess)
    return good.join(tops, list(keys)).groupBy(*keys, group, "upper", bin_.alias("bin")).agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, keys: Sequence[str], x: str, y: str, *, lower: float, upper: float, n_bins: int) -> DataFrame:
    inside = df.where(F.col(x).between(lower, upper) & F.col(y).between(lower, upper))
    return inside.groupBy(
        *keys, bin_index(F.col(x), n_bins, upper, lower).alias("bx"), bin_index(F.col(y), n_bins, upper, lower).alias("by")
    ).agg(F.count("*").alias("n"))


def count_map(df: DataFrame, keys: Sequence[str], x: str, y: str, *, x0: int, y0: int, per_pixel: int = 4) -> DataFrame:
    """Pooled point counts at a fraction of a pixel, origin at the crop corner."""
    place = lambda c, o: F.floor((F.col(c) - o + 0.5) * per_pixel).cast("int")
    return df.groupBy(*keys, place(x, x0).alias("mx"), place(y, y0).alias("my")).agg(F.count("*").alias("n"))


def unique_mode(counts: DataFrame, keys: Sequence[str], *, lower: float, width: float) -> DataFrame:
    """Centre of the fullest bin, unavailable when several bins share the maximum."""
    w = Window.partitionBy(*keys)
    top = counts.withColumn("top", F.max("n").over(w)).where("n = top")
    return top.groupBy(*keys).agg(
        F.when(F.count("*") == 1, F.lit(lower) + (F.min("bin") + 0.5) * F.lit(width)).alias("mode"),
        F.when(F.count("*") == 1, "unique_native_histogram_bin").otherwise("unavailable_tied_or_empty_bins").alias("mode_status"))


def describe(df: DataFrame, keys: Sequence[str], value: str, *, lower: float, upper: float, n_bins: int) -> DataFrame:
    """Mean, exact median and unique mode bin of a finite column."""
    good = df.where(finite(F.col(value)))
    mean = good.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    median = exact_quantiles(good, keys, value, [0.5]).select(*keys, F.col("quantile").alias("median"))
    mode = unique_mode(histogram(df, keys, value, lower=lower, upper=upper, n_bins=n_bins), keys, lower=lower, width=(upper - lower) / n_bins)
    return mean.join(median, list(keys)).join(mode, list(keys), "left")
