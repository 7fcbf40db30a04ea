"""Per-cell scalar records and their summaries over replicates and conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.functions.columns import close, finite, ratio, reasons

COUNTS = ("on", "not_on", "unknown", "qc_excluded", "selected", "roi_candidates")


def parse_count(text: Column) -> Column:
    """Non-negative integer from saved text; booleans, fractions and signs give NULL."""
    clean = F.trim(text.cast("string"))
    return F.when(clean.rlike(r"^[0-9]+(\.0+)?$"), F.split(clean, r"\.")[0].try_cast("bigint"))


def count_expectations() -> list[tuple[str, Column]]:
    """Saved counts must be whole and must add up; a saved percentage must agree with them."""
    known = F.col("on") + F.col("not_on")
    return [
        ("counts_present", F.col("on").isNotNull() & F.col("not_on").isNotNull() & F.col("unknown").isNotNull()),
        ("selected_total", F.col("on") + F.col("not_on") + F.col("unknown") == F.col("selected")),
        ("candidate_total", F.col("selected") + F.col("qc_excluded") == F.col("roi_candidates")),
        ("percentage_agrees", F.col("on_pct").eqNullSafe(F.lit(None)) & (known == 0)
         | close(F.col("on_pct"), F.col("on") * 100.0 / known, 1e-8)),
    ]


def metric_validity(cells: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Add ``validity`` MAP<metric, boolean> and ``why`` MAP<metric, array of reasons>."""
    names = F.array(*[F.lit(m) for m in metrics])
    ok = [finite(F.col(m)) & (F.col(m) >= 0) for m in metrics]
    why = [reasons([("missing", F.col(m).isNull()), ("not_finite", F.col(m).isNotNull() & ~finite(F.col(m))),
                    ("negative", F.col(m) < 0)]) for m in metrics]
    return cells.withColumn("validity", F.map_from_arrays(names, F.array(*ok))).withColumn(
        "why", F.map_from_arrays(names, F.array(*why)))


def expected_inventory(inventory: DataFrame, cells: DataFrame, *, key: str) -> DataFrame:
    """Every expected cell with its values; a cell without a record is pending and keeps NULLs."""
    marked = cells.withColumn("__done", F.lit(True))
    out = inventory.join(marked, key, "left")
    return out.withColumn("status", F.when(F.col("__done"), "complete").otherwise("pending")).drop("__done")


def unexpected_cells(inventory: DataFrame, cells: DataFrame, *, key: str, identity: Sequence[str]) -> DataFrame:
    """Completed cells that are not expected, or whose identity differs from the inventory."""
    expected = inventory.select(key, *[F.col(c).alias(f"__{c}") for c in identity], F.lit(True).alias("__known"))
    joined = cells.join(expected, key, "left")
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    problem = F.when(F.col("__known").isNull(), "not_expected").when(~same, "identity_differs")
    return joined.withColumn("problem", problem).where("problem is not null").select(key, *identity, "problem")


def merge_completions(registries: Sequence[DataFrame]) -> DataFrame:
    """Union registries of (sample_id, path, digest): one row per sample.

    The same path counts once. Equal digests mean one result; different digests are a conflict.
    """
    union = registries[0]
    for other in registries[1:]:
        union = union.unionByName(other, allowMissingColumns=True)
    # first per (sample, path) so that repeated registrations of one path collapse map-side
    once = union.groupBy("sample_id", "path").agg(F.min("digest").alias("digest"))
    out = once.groupBy("sample_id").agg(
        F.count("*").alias("paths"), F.countDistinct("digest").alias("digests"),
        F.min_by("digest", F.struct("path", "digest")).alias("digest"), F.min("path").alias("path"),
    )
    return out.withColumn("status", F.when(F.col("digests") > 1, "conflict").otherwise("complete"))


def source_agreement(sources: DataFrame, *, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys for which several sources report different values."""
    return sources.groupBy(key).agg(
        F.count("*").alias("sources"), F.countDistinct(F.struct(*columns)).alias("versions")
    ).where("versions <> 1")


def cardinality_check(cells: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Found against expected number of cells per key, both directions."""
    found = cells.groupBy(*keys).agg(F.count("*").alias("found"))
    out = found.join(expected, list(keys), "full_outer")
    return out.withColumn("found", F.coalesce("found", F.lit(0))).withColumn("ok", F.col("found").eqNullSafe(F.col("expected")))


def grouped_counts(cells: DataFrame, counts: Sequence[str] = COUNTS) -> DataFrame:
    """Sums and per-cell averages by (condition, br, protein) and by (condition, protein), blanks ignored."""
    sets = [[F.col("condition"), F.col("br"), F.col("protein")], [F.col("condition"), F.col("protein")]]
    out = cells.groupingSets(sets, F.col("condition"), F.col("br"), F.col("protein")).agg(
        F.grouping("br").cast("int").alias("is_condition"), F.count("*").alias("cells"),
        F.count("roi_candidates").alias("cells_with_counts"), *[F.sum(c).alias(c) for c in counts],
    )
    n = F.col("cells_with_counts")
    return out.withColumns({f"{c}_per_cell": ratio(F.col(c), n) for c in counts})


def count_means(cells: DataFrame, values: Sequence[str]) -> DataFrame:
    """Three averages side by side: per replicate, over all cells, and over replicate means."""
    has = cells.where(F.col(values[0]).isNotNull())
    br = has.groupBy("condition", "br", "protein").agg(
        *[F.avg(v).alias(v) for v in values], F.count("*").alias("cells"), *[F.sum(v).alias(f"__{v}") for v in values])
    top = br.groupBy("condition", "protein").agg(
        F.sum("cells").alias("cells"), F.count("*").alias("replicates"),
        *[F.avg(v).alias(f"e_{v}") for v in values], *[(F.sum(f"__{v}") / F.sum("cells")).alias(f"p_{v}") for v in values])
    none = F.lit(None).cast(cells.schema["br"].dataType).alias("br")

    def rows(df, code, br_col, prefix, replicates):
        return df.select("condition", br_col, "protein", F.lit(code).alias("averaging"), "cells", replicates.alias("replicates"),
                         *[F.col(f"{prefix}{v}").alias(v) for v in values])

    return (
        rows(br, "cell_mean_within_BR", F.col("br"), "", F.lit(1).cast("bigint"))
        .unionByName(rows(top, "all_cell_mean", none, "p_", F.col("replicates")))
        .unionByName(rows(top, "equal_replica_mean", none, "e_", F.col("replicates")))
    )


def endpoint_descriptives(cells: DataFrame, endpoints: Sequence[str]) -> DataFrame:
    """Condition descriptives of replicate means with the pooled cell mean, per protein and endpoint."""
    long = cells.unpivot(["protein", "condition", "br"], list(endpoints), "endpoint", "value")
    br = long.groupBy("protein", "condition", "br", "endpoint").agg(
        F.count("value").alias("n"), F.count("*").alias("available"), F.avg("value").alias("m"), F.sum("value").alias("s"))
    return br.groupBy("protein", "condition", "endpoint").agg(
        F.count("m").alias("n_br"), F.sum("n").alias("n_cells"), F.sum("available").alias("n_cells_available"),
        F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("sem"),
        ratio(F.sum("s"), F.sum("n")).alias("pooled_cell_mean"))


def ratio_audit(cells: DataFrame) -> DataFrame:
    """Three estimators of On%: mean of cell ratios, pooled ratio, equal-replicate mean of ratios."""
    br = cells.groupBy("protein", "condition", "br").agg(
        F.count("*").alias("n_cells"), F.sum("on").alias("on"), F.sum("not_on").alias("not_on"),
        F.avg("on_pct").alias("m"), F.sum("on_pct").alias("s"), F.count("on_pct").alias("k"))
    pooled = ratio(F.sum("on") * 100.0, F.sum("on") + F.sum("not_on"))
    return br.groupBy("protein", "condition").agg(
        F.sum("n_cells").alias("n_cells"), F.count("*").alias("n_br"), ratio(F.sum("s"), F.sum("k")).alias("mean_of_cell_ratios"),
        pooled.alias("pooled_ratio"), F.avg("m").alias("equal_br_mean_of_ratios"))
