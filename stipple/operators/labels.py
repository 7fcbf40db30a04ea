"""Labels on points: attaching, recoding, counting, comparing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.functions.columns import close, finite

# Saved label names and the group each belongs to.
LABEL_GROUPS = {
    "mito-compatible": "On",
    "non-mito-compatible": "Not-on",
    "unknown": "unknown",
    "On": "On",
    "Not-on": "Not-on",
}
GROUPS = ("On", "Not-on", "unknown")
HESSIAN_STATUS = "full_observed_Hessian"  # Fixed value: marks a usable standard error.


def recode(label: Column, mapping: Mapping[str, str] = LABEL_GROUPS) -> Column:
    """Group of a saved label; NULL for a label outside the list."""
    pairs = [F.lit(v) for item in mapping.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), label)


def attach_labels(points: DataFrame, labels: DataFrame, *, key: str = "uid") -> DataFrame:
    """Full outer join on the key with ``side`` = both / points_only / labels_only.

    One join gives the attached rows and both completeness checks. Rows keep every column.
    """
    a = points.withColumn("__p", F.lit(True))
    b = labels.withColumn("__l", F.lit(True))
    side = F.when(F.col("__p").isNull(), "labels_only").when(F.col("__l").isNull(), "points_only").otherwise("both")
    return a.join(b, key, "full_outer").withColumn("side", side).drop("__p", "__l")


def selected_expectations(*, n_frames: int, frame_s: float) -> list[tuple[str, Column]]:
    """What a selected row must satisfy before it may enter the pair analysis."""
    return [
        ("finite_position", finite(F.col("x_px")) & finite(F.col("y_px"))),
        ("positive_error", (F.col("x_se_nm") > 0) & (F.col("y_se_nm") > 0)),
        ("known_label", F.col("grp").isin(*GROUPS)),
        ("frame_in_range", F.col("frame").between(0, n_frames - 1)),
        ("time_matches_frame", close(F.col("time_s"), F.col("frame") * F.lit(frame_s), 1e-9)),
        ("error_semantics", F.col("uncertainty_status").contains(HESSIAN_STATUS)),
    ]


def table_expectations() -> list[tuple[str, Column]]:
    """What every localization row must satisfy against its detection."""
    return [
        ("uid_suffix", F.col("uid").endswith(F.concat(F.lit("-"), F.col("spot_id")))),
        ("detection_exists", F.col("d_frame").isNotNull()),
        ("same_frame", F.col("frame") == F.col("d_frame")),
        ("same_position", close(F.col("x_px"), F.col("d_x_px"), 1e-10) & close(F.col("y_px"), F.col("d_y_px"), 1e-10)),
        ("selected_implies_qc", ~F.col("selected") | F.col("qc")),
    ]


def index_match_report(fits: DataFrame, detections: DataFrame, *, key: str = "sample_id", index: str = "candidate_index") -> DataFrame:
    """Fits against detections by candidate index, per sample: missing, repeated and unknown indices, and is the match one to one?"""
    m = fits.groupBy(key, index).agg(F.count("*").alias("n"))
    d = detections.select(key, index, F.lit(True).alias("__d"))
    both = d.join(m, [key, index], "full_outer")
    right = F.coalesce((F.col("n") == 1) & F.col("__d"), F.lit(False))
    return both.groupBy(key).agg(
        F.count("n").alias("fitted_candidates"), F.coalesce(F.sum("n"), F.lit(0)).alias("fits"), F.count_if(F.col("n") > 1).alias("fitted_twice"),
        F.count_if(F.col("n").isNull()).alias("without_fit"), F.count_if(F.col("__d").isNull()).alias("without_detection"),
        F.bool_and(right).alias("one_to_one"))


def frame_class_counts(points: DataFrame, *, key: str = "sample_id") -> DataFrame:
    """Counts per frame of each class, with every frame of the table's range present for every sample.

    One aggregate gives the frame counts; the frames of a sample are bounded, so they are
    gathered into a map and expanded over the full frame range without a join.
    """
    kept = F.col("qc")
    per_frame = points.groupBy(key, "frame").agg(
        *[F.count_if(kept & (F.col("grp") == g)).alias(g.replace("-", "_").lower()) for g in GROUPS],
        F.count_if(~kept).alias("qc_excluded"), F.count("*").alias("roi_candidates"),
    )
    return zero_filled(per_frame, [key])


def zero_filled(per_frame: DataFrame, keys: Sequence[str], *, frame: str = "frame") -> DataFrame:
    """Expand sparse per-frame counts to all frames from the table's first to its last, absent counts being zero.

    The range is that of the data, so no frame can lie outside it; rows without a frame have no place in it.
    """
    per_frame = per_frame.where(F.col(frame).isNotNull())
    first, last = per_frame.select(F.min(frame)).scalar(), per_frame.select(F.max(frame)).scalar()
    values = [c for c in per_frame.columns if c not in (*keys, frame)]
    one = per_frame.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(frame, F.struct(*values)))).alias("__m"))
    grid = one.select(*keys, "__m", F.explode(F.sequence(first, last)).alias(frame))
    at = F.try_element_at("__m", F.col(frame))
    return grid.select(*keys, frame, *[F.coalesce(at[v], F.lit(0)).alias(v) for v in values])


def block_rollup(frame_counts: DataFrame, *, block_frames: int, key: str = "sample_id") -> DataFrame:
    """Sums per block and per sample in one pass; the sample row has block NULL."""
    values = [c for c in frame_counts.columns if c not in (key, "frame")]
    blocked = frame_counts.withColumn("block", F.floor(F.col("frame") / block_frames).cast("int"))
    return blocked.groupingSets([[F.col(key), F.col("block")], [F.col(key)]], F.col(key), F.col("block")).agg(
        F.grouping("block").cast("int").alias("is_total"), *[F.sum(v).alias(v) for v in values]
    )


def conservation_violations(counts: DataFrame) -> DataFrame:
    """Rows whose class counts do not add up to their candidates."""
    parts = F.col("on") + F.col("not_on") + F.col("unknown") + F.col("qc_excluded")
    return counts.where(parts != F.col("roi_candidates"))


def transition_matrix(labelings: DataFrame, *, groups: Sequence[str] = GROUPS) -> DataFrame:
    """Complete from/to table of two labelings (columns a and b) of the same items."""
    seen = labelings.groupBy(F.col("a").alias("from_label"), F.col("b").alias("to_label")).agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(g) for g in groups])
    spark = labelings.sparkSession
    full = spark.range(1).select(F.explode(names).alias("from_label")).select("from_label", F.explode(names).alias("to_label"))
    return full.join(seen, ["from_label", "to_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def flip_counts(labelings: DataFrame) -> DataFrame:
    """One row: how many items changed group, involve unknown, or stayed."""
    a, b = F.col("a"), F.col("b")
    unknown = (a == "unknown") | (b == "unknown")
    return labelings.agg(
        F.count_if((a == "On") & (b == "Not-on")).alias("on_to_not_on"),
        F.count_if((a == "Not-on") & (b == "On")).alias("not_on_to_on"),
        F.count_if((a != b) & unknown).alias("unknown_involved"), F.count_if(a == b).alias("unchanged"),
    )


def method_counts(labelings: DataFrame, methods: Sequence[str] = ("a", "b")) -> DataFrame:
    """Per method: class counts, and On% on its own known items and on items known to all methods."""
    known_all = F.lit(True)
    for m in methods:
        known_all = known_all & (F.col(m) != "unknown")
    long = labelings.withColumn("common", known_all).unpivot(["uid", "common"], list(methods), "method", "label")
    on, off = F.col("label") == "On", F.col("label") == "Not-on"

    def pct(extra):
        known = F.count_if((on | off) & extra)
        return F.when(known > 0, F.count_if(on & extra) * 100.0 / known)

    return long.groupBy("method").agg(
        F.count("*").alias("items"), F.count_if(on).alias("on_n"), F.count_if(off).alias("not_on_n"),
        F.count_if(F.col("label") == "unknown").alias("unknown_n"), F.count_if("common").alias("common_known"),
        pct(F.lit(True)).alias("on_pct"), pct(F.col("common")).alias("on_pct_common"),
    )


def audit_counts(points: DataFrame, *, statuses: Sequence[str], key: str = "sample_id") -> DataFrame:
    """Zero-filled per-frame counts of each audit status, plus selected and excluded."""
    per_frame = points.groupBy(key, "frame").agg(
        *[F.count_if(F.col("audit") == s).alias(s) for s in statuses],
        F.count_if("qc").alias("selected"), F.count_if(~F.col("qc")).alias("excluded"),
    )
    return zero_filled(per_frame, [key])


def detection_counts(points: DataFrame, *, inside: Column, key: str = "sample_id") -> DataFrame:
    """Zero-filled per-frame detections, whole field and inside the region."""
    per_frame = points.groupBy(key, "frame").agg(F.count("*").alias("whole_field"), F.count_if(inside).alias("inside"))
    return zero_filled(per_frame, [key])


def relabel_invariance(a: DataFrame, b: DataFrame) -> DataFrame:
    """All-pair counts under two labelings of the same points, per sample and component, with equality."""
    left = a.groupBy("sample_id", "component").agg(F.sum("n").alias("n_a"))
    right = b.groupBy("sample_id", "component").agg(F.sum("n").alias("n_b"))
    joined = left.join(right, ["sample_id", "component"], "full_outer")
    return joined.withColumn("equal", F.col("n_a").eqNullSafe(F.col("n_b")))


def identity_disagreements(df: DataFrame, identity: Mapping[str, Column]) -> DataFrame:
    """Rows whose stored identity differs from the expected one, per identity column."""
    return df.agg(*[F.count_if(F.col(k).isNotNull() & (F.col(k) != v)).alias(k) for k, v in identity.items()])
