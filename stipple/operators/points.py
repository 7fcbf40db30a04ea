"""Row-level point operators: checks, windows on distinct frames, selection, public split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipple.operators.skew import numbered


def frame_steps(points: DataFrame, key: str = "sample_id", frame: str = "frame") -> DataFrame:
    """Step from each distinct frame to the next, per sample."""
    w = Window.partitionBy(key).orderBy(frame)
    return points.select(key, frame).distinct().withColumn("step", F.col(frame) - F.lag(frame).over(w))


def in_rectangle(df: DataFrame, x: tuple[float, float], y: tuple[float, float], *, cols=("x_um", "y_um")) -> DataFrame:
    """Rows inside a closed rectangle."""
    return df.where(F.col(cols[0]).between(*x) & F.col(cols[1]).between(*y))


def axial_slab(df: DataFrame, low: float, high: float, *, z: str = "z_um") -> DataFrame:
    """Rows inside a closed slab, projected to the plane."""
    return df.where(F.col(z).between(low, high)).drop(z)


def candidate_index(points: DataFrame, key: str = "sample_id", order: Sequence[str] = ("frame", "x_um", "y_um", "uid")) -> DataFrame:
    """Zero-based index of each row in the canonical order of its sample."""
    return numbered(points, [key], list(order), "candidate_index").withColumn(
        "candidate_index", F.col("candidate_index") - 1
    )


def shuffled_ids(points: DataFrame, seed: int, *, frame: str = "frame", uid: str = "uid") -> DataFrame:
    """Fresh detection ids: frames in order, rows within a frame in a seeded random order."""
    mixed = points.withColumn("__mix", F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(frame), F.col(uid))))
    return numbered(mixed, [], [frame, "__mix"], "detection_id").withColumn(
        "detection_id", F.col("detection_id") - 1
    ).drop("__mix")


def public_split(truth: DataFrame, visible: str, public: Sequence[str], key: str = "detection_id") -> tuple[DataFrame, DataFrame]:
    """A detection table with only public columns, and the id-to-truth table beside it."""
    seen = truth.where(F.col(visible))
    hidden = [c for c in seen.columns if c not in public or c == key]
    return seen.select(*public), seen.select(*hidden)


def lag_displacement(points: DataFrame, lags: Sequence[int], *, particle: str, x: str, y: str) -> DataFrame:
    """Mean absolute displacement along two axes for several frame lags, and their ratio."""
    later = points.select(particle, F.col("frame").alias("frame2"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    ahead = points.select(particle, x, y, "frame", F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag")).withColumn(
        "frame2", F.col("frame") + F.col("lag")
    )
    out = ahead.join(later, [particle, "frame2"]).groupBy("lag").agg(
        F.count("*").alias("pairs"),
        F.avg(F.abs(F.col("x2") - F.col(x))).alias("mean_abs_x"),
        F.avg(F.abs(F.col("y2") - F.col(y))).alias("mean_abs_y"),
    )
    return out.withColumn("axis_ratio", F.when(F.col("mean_abs_y") > 0, F.col("mean_abs_x") / F.col("mean_abs_y")))


def axis_ranges(points: DataFrame, *, particle: str, x: str, y: str) -> DataFrame:
    """Full-record extent of each particle on both axes."""
    return points.groupBy(particle).agg((F.max(x) - F.min(x)).alias("x_range"), (F.max(y) - F.min(y)).alias("y_range"))
