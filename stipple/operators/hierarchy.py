"""Equal-weight roll-ups: cells to replicates to conditions, for curves and scalars.

Every level is a plain two-phase aggregate of the level below, so a crowded replicate is
combined map-side. Means are averaged level by level and never weighted by counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.functions.columns import finite, reasons
from stipple.operators.curves import area_normalized, peak_normalized

AREA_GUARD = 0.01  # Fixed value: a curve with a smaller signed area has no shape.


def band(value: str, prefix: str = "") -> list[Column]:
    """mean, sample SD, SEM and mean +- SD of a column; spread is NULL below two rows."""
    n, mean, sd = F.count(value), F.avg(value), F.stddev_samp(value)
    return [
        n.alias(f"{prefix}n"), mean.alias(f"{prefix}mean"), sd.alias(f"{prefix}sd"),
        (sd / F.sqrt(n)).alias(f"{prefix}sem"),
        (mean - sd).alias(f"{prefix}low"), (mean + sd).alias(f"{prefix}high"),
    ]


def equal_cell_mean(curves: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean curve over cells: contributions are averaged, not their factors."""
    return curves.groupBy(*keys, "bin").agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n_cells"))


def replicate_totals(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean beta and summed pair counts of a replicate's cells (one input row per cell)."""
    return cells.groupBy(*keys).agg(
        F.count("*").alias("n_cells"), F.avg("beta").alias("beta"),
        F.sum("total_pairs").alias("total_pairs"), F.sum("background_pairs").alias("background_pairs"),
    )


def equal_replicate_band(replicates: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean, SD, SEM and band per bin over replicate curves, long by component."""
    long = replicates.unpivot([*keys, "bin"], list(values), "component", "value")
    return long.groupBy(*keys, "component", "bin").agg(*band("value"))


def metric_statistics(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Statistics of several metrics over rows, ignoring values that are not finite."""
    long = rows.unpivot(list(keys), list(metrics), "metric", "value")
    return long.withColumn("value", F.when(finite(F.col("value")), F.col("value"))).groupBy(*keys, "metric").agg(
        F.count("*").alias("n_rows"), *band("value")
    )


def curve_eligibility(
    curves: DataFrame, cell: Sequence[str], *, groups: Sequence[str], n_bins: int, width: float, min_area: float = AREA_GUARD
) -> DataFrame:
    """One row per cell: whether all groups have a usable curve, and the reasons if not."""
    agg, tests = [], []
    for i, g in enumerate(groups):
        own = F.when(F.col("grp") == g, F.col("value"))
        agg += [
            F.count_if(F.col("grp") == g).alias(f"__b{i}"),
            F.count_if((F.col("grp") == g) & finite(F.col("value"))).alias(f"__f{i}"),
            F.sum(own * width).alias(f"__a{i}"), F.max(own).alias(f"__m{i}"),
        ]
        bins, ok, area, top = (F.col(f"__{x}{i}") for x in "bfam")
        usable = (bins == n_bins) & (ok == n_bins)
        tests += [
            (f"{g}:missing_curve", bins == 0),
            (f"{g}:unexpected_bins", (bins > 0) & (bins != n_bins)),
            (f"{g}:nonfinite_curve", (bins == n_bins) & (ok < n_bins)),
            (f"{g}:near_zero_signed_area", usable & (F.abs(area) <= min_area)),
            (f"{g}:no_positive_peak", usable & (top <= 0)),
        ]
    out = curves.groupBy(*cell).agg(*agg).withColumn("reasons", reasons(tests))
    return out.select(*cell, (F.size("reasons") == 0).alias("eligible"), "reasons")


def cell_states(
    inventory: DataFrame, curves: DataFrame, *, groups: Sequence[str], n_bins: int, width: float
) -> DataFrame:
    """Inventory rows (cell, br, condition, status) with eligibility and sorted reasons."""
    judged = curve_eligibility(curves, ["cell"], groups=groups, n_bins=n_bins, width=width)
    complete = F.col("status") == "complete"
    missing = F.array(*[F.lit(f"{g}:missing_curve") for g in groups])
    why = F.when(complete, F.coalesce("reasons", missing)).otherwise(
        F.array(F.when(F.col("status") == "pending", "not_completed").otherwise(F.col("status")))
    )
    return inventory.join(judged, "cell", "left").select(
        "cell", "br", "condition", "status",
        (complete & F.coalesce("eligible", F.lit(False))).alias("included"), F.array_sort(why).alias("reasons"),
    )


def hierarchy_curves(
    states: DataFrame, curves: DataFrame, *, groups: Sequence[str], n_bins: int, width: float, min_area: float = AREA_GUARD
) -> DataFrame:
    """Summary curves in three views at replicate, condition and comparison level, long form.

    Columns: level, condition, br, grp, view, bin, mean, sd, sem, n. Replicate means are of
    eligible cells; only replicates whose mean curves are themselves eligible, and none of
    whose cells is in conflict, enter a condition. Area shapes are normalized per cell and
    then only averaged; peak shapes are normalized per cell within a replicate but per
    replicate mean within a condition.
    """
    blocked = states.groupBy("condition", "br").agg(F.bool_or(F.col("status") == "conflict").alias("blocked"))
    members = states.where("included").select("cell", "condition", "br")
    usable = curves.select("cell", "grp", "bin", "value").join(members, "cell")
    usable = peak_normalized(area_normalized(usable, ["cell", "grp"], "value", width), ["cell", "grp"], "value")
    br = usable.groupBy("condition", "br", "grp", "bin").agg(
        F.avg("value").alias("signed"), F.avg("area_value").alias("area"), F.avg("peak_value").alias("peak"),
        F.count("*").alias("n"),
    )
    br = br.join(blocked.where("not blocked").select("condition", "br"), ["condition", "br"], "left_semi")
    views = ["signed", "area", "peak"]
    spreadless = F.lit(None).cast("double")
    br_rows = br.unpivot(["condition", "br", "grp", "bin", "n"], views, "view", "mean").select(
        F.lit("BR").alias("level"), "condition", "br", "grp", "view", "bin", "mean",
        spreadless.alias("sd"), spreadless.alias("sem"), "n",
    )
    good = curve_eligibility(
        br.withColumn("value", F.col("signed")), ["condition", "br"], groups=groups, n_bins=n_bins, width=width, min_area=min_area
    ).where("eligible")
    stopped = blocked.where("blocked").select("condition")
    ready = br.join(good, ["condition", "br"], "left_semi").join(stopped, "condition", "left_anti")
    ready = peak_normalized(ready, ["condition", "br", "grp"], "signed").withColumn("peak", F.col("peak_value"))
    long = ready.unpivot(["condition", "grp", "bin"], views, "view", "mean0")
    cond = long.groupBy("condition", "grp", "view", "bin").agg(
        F.avg("mean0").alias("mean"), F.stddev_samp("mean0").alias("sd"),
        (F.stddev_samp("mean0") / F.sqrt(F.count("mean0"))).alias("sem"), F.count("mean0").alias("n"),
    )
    none = F.lit(None).cast(states.schema["br"].dataType).alias("br")
    levels = F.explode(F.array(F.lit("condition"), F.lit("comparison"))).alias("level")
    upper = cond.select(levels, "condition", none, "grp", "view", "bin", "mean", "sd", "sem", "n")
    return br_rows.unionByName(upper)


def node_progress(states: DataFrame) -> DataFrame:
    """Counts and status of each replicate, each condition and the whole comparison."""
    done = F.col("status").isin("complete", "invalid_completed", "conflict")
    nodes = states.groupingSets(
        [[F.col("condition"), F.col("br")], [F.col("condition")], []], F.col("condition"), F.col("br")
    ).agg(
        F.grouping_id().alias("depth"),
        F.count("cell").alias("expected"), F.count_if(done).alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if("included").alias("included"),
        F.bool_or(F.col("status") == "conflict").alias("blocked"),
        F.countDistinct("condition", "br").alias("expected_brs"),
        F.countDistinct(F.when(F.col("included"), F.struct("condition", "br"))).alias("brs_with_cells"),
    )
    terminal = F.col("completed") + F.col("failed")
    status = (
        F.when(F.col("blocked") & (F.col("depth") < 3), "BLOCKED_SOURCE_CONFLICT")
        .when(terminal < F.col("expected"), "PROGRESS")
        .when((F.col("failed") > 0) | (F.col("included") < F.col("completed")), "COMPLETE_WITH_FAILURES_OR_EXCLUSIONS")
        .otherwise("COMPLETE")
    )
    level = F.when(F.col("depth") == 0, "BR").when(F.col("depth") == 1, "condition").otherwise("comparison")
    return nodes.select(
        level.alias("level"), "condition", "br", "expected", "completed", "failed", terminal.alias("terminal"),
        "included", "expected_brs", "brs_with_cells", status.alias("status"),
    )


def node_members(states: DataFrame) -> DataFrame:
    """Member and exclusion rows of every replicate node, reasons joined for export."""
    return states.select(
        "condition", "br", "cell", "status",
        F.when(F.col("included"), "member").otherwise("exclusion").alias("role"),
        F.array_join("reasons", ";").alias("reasons"),
    )


def two_level_metrics(cells: DataFrame, metrics: Sequence[str], *, top: Sequence[str] = ("condition",), mid: str = "br") -> DataFrame:
    """Cell to replicate to condition statistics of scalar metrics, each metric with its own validity.

    Replicate rows average valid cells; condition rows average replicate means. The
    comparison row carries only counts.
    """
    top = list(top)
    long = cells.unpivot([*top, mid], list(metrics), "metric", "value")
    long = long.withColumn("value", F.when(finite(F.col("value")), F.col("value")))
    br = long.groupBy(*top, mid, "metric").agg(*band("value"), F.count("*").alias("n_available")).drop("low", "high")
    upper = br.where("n > 0").groupBy(*top, "metric").agg(
        F.count("mean").alias("n"), F.avg("mean").alias("mean0"), F.stddev_samp("mean").alias("sd0"),
        F.sum("n").alias("n_cells"),
    )
    typed = cells.schema[mid].dataType
    br_rows = br.select(F.lit("BR").alias("level"), *top, F.col(mid), "metric", "n", "mean", "sd", "sem", F.col("n").alias("n_cells"))
    cond_rows = upper.select(
        F.lit("condition").alias("level"), *top, F.lit(None).cast(typed).alias(mid), "metric", "n",
        F.col("mean0").alias("mean"), F.col("sd0").alias("sd"), (F.col("sd0") / F.sqrt("n")).alias("sem"), "n_cells",
    )
    return br_rows.unionByName(cond_rows)


def comparison_counts(cells: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per metric: how many cells, replicates and conditions have a valid value. No mean."""
    long = cells.unpivot(["condition", "br"], list(metrics), "metric", "value")
    # one row per replicate first: the distinct counts then see only the few replicate keys
    br = long.groupBy("metric", "condition", "br").agg(F.count_if(finite(F.col("value"))).alias("n"))
    return br.groupBy("metric").agg(
        F.sum("n").alias("valid_cells"), F.count_if(F.col("n") > 0).alias("valid_brs"),
        F.countDistinct(F.when(F.col("n") > 0, F.col("condition"))).alias("valid_conditions"),
    )


def grid_mismatches(curves: DataFrame, grid: Sequence[str] = ("left_um", "right_um")) -> DataFrame:
    """Bins whose edges differ between series; empty when all series share one grid."""
    return curves.groupBy("bin").agg(*[F.countDistinct(c).alias(f"{c}_values") for c in grid]).where(
        " or ".join(f"{c}_values <> 1" for c in grid)
    )


def version_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows present in only one of two summary versions, with the side they are on."""
    return old.exceptAll(new).withColumn("only_in", F.lit("old")).unionByName(
        new.exceptAll(old).withColumn("only_in", F.lit("new"))
    )
