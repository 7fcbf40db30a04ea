"""Tables made for readers: ordered, labelled, one fixed schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.functions.columns import label_number, preferred_rank


def reader_table(cells: DataFrame, *, preferred: Sequence[str]) -> DataFrame:
    """Replicate means with display order columns and a note where valid numbers differ."""
    br = cells.groupBy("condition", "br").agg(
        F.avg("on_pct").alias("p"), F.avg("area").alias("area"), F.count("on_pct").alias("np"), F.count("area").alias("na"))
    note = F.when(F.col("np") != F.col("na"), F.concat(
        F.lit("valid n differs: on_pct "), F.col("np"), F.lit(", area "), F.col("na"))).otherwise("")
    return br.select(
        "condition", "br", label_number(F.col("br")).alias("br_order"), preferred_rank(F.col("condition"), preferred).alias("condition_order"),
        (F.col("p") / 100).alias("on_fraction"), "area", note.alias("note"))


def batch_summary(inventory: DataFrame, done: DataFrame) -> DataFrame:
    """One row per replicate of every condition, also those without any cell yet."""
    joined = inventory.join(done, "sample_id", "left")
    out = joined.groupBy("condition", "br").agg(
        F.count("sample_id").alias("cells"), F.count("points_n").alias("analyzed"), F.coalesce(F.sum("points_n"), F.lit(0)).alias("points_n"))
    status = F.when(F.col("cells") == 0, "pending").when(F.col("analyzed") < F.col("cells"), "partial").otherwise("complete")
    return out.withColumn("status", status)


def reader_tables(cells: DataFrame, *, preferred: Sequence[str]) -> dict[str, DataFrame]:
    """Condition summary, BR summary, localization means and cells, each with one fixed schema.

    A replicate without any usable cell keeps its row with NULL values.
    """
    base = cells.select(
        "condition", "br", "protein", "cell", "selected", "on", "not_on", (F.col("on_pct") / 100).alias("on_fraction"), "area")
    order = preferred_rank(F.col("condition"), preferred).alias("condition_order")
    values = [F.avg("on_fraction").alias("on_fraction"), F.avg("area").alias("area")]
    valid = [F.count("on_fraction").alias("n_on"), F.count("area").alias("n_area")]
    br = base.groupBy("condition", "br", "protein").agg(*values, *valid, F.count("*").alias("cells"))
    # condition values are means of replicate means; the numbers of cells are summed
    cond = br.groupBy("condition", "protein").agg(
        *values, F.sum("n_on").alias("n_on"), F.sum("n_area").alias("n_area"), F.count("*").alias("replicates"))
    note = F.when(F.col("n_on") != F.col("n_area"), "valid n differs between metrics").otherwise("").alias("note")
    means = base.where("selected is not null").groupBy("condition", "br", "protein").agg(
        F.count("*").alias("cells"), *[F.avg(c).alias(f"{c}_mean") for c in ("selected", "on", "not_on")])
    return {
        "condition_summary": cond.select(order, "*", note),
        "br_summary": br.select(order, label_number(F.col("br")).alias("br_order"), "*", note),
        "localization_means": means.select(order, "*"),
        "cells": base.select(order, label_number(F.col("br")).alias("br_order"), "*"),
    }
