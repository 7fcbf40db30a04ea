"""Named expectations: they split rows or report counts, and never drop anything silently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.functions.columns import reasons


def split_failures(df: DataFrame, expectations: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet every expectation, and the others with a ``message`` naming what failed.

    An expectation that evaluates to NULL counts as failed.
    """
    failed = reasons([(name, ~F.coalesce(test, F.lit(False))) for name, test in expectations])
    marked = df.withColumn("__why", failed)
    good = marked.where(F.size("__why") == 0).drop("__why")
    bad = marked.where(F.size("__why") > 0).withColumn("message", F.array_join("__why", ";")).drop("__why")
    return good, bad


def violation_counts(df: DataFrame, expectations: Sequence[tuple[str, Column]], keys: Sequence[str] = ()) -> DataFrame:
    """How many rows break each expectation, one row per key and expectation."""
    names = [n for n, _ in expectations]
    counted = df.groupBy(*keys).agg(
        F.count("*").alias("rows_n"),
        *[F.count_if(~F.coalesce(test, F.lit(False))).alias(f"v{i}") for i, (_, test) in enumerate(expectations)],
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"v{i}").alias("violations")) for i, n in enumerate(names)])
    return counted.select(*keys, "rows_n", F.explode(pairs).alias("__p")).select(*keys, "rows_n", "__p.check", "__p.violations")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Schema check before any row is read."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df.select(*columns)


def first_present(df: DataFrame, candidates: Sequence[str], name: str) -> DataFrame:
    """Rename the first existing candidate column to ``name``."""
    for c in candidates:
        if c in df.columns:
            return df.withColumnRenamed(c, name)
    raise ValueError(f"none of {', '.join(candidates)} is present")


def missing_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only, with that side's name."""
    a, b = left.select(*keys), right.select(*keys)
    return a.join(b, list(keys), "left_anti").withColumn("only_in", F.lit("left")).unionByName(
        b.join(a, list(keys), "left_anti").withColumn("only_in", F.lit("right"))
    )


def replicate_compatibility(curves: DataFrame, group: Sequence[str], replicate: str, value: str) -> DataFrame:
    """Per group: number of replicates, distinct ids, distinct inputs (by digest) and distinct bin grids.

    A replicate's curve has a bounded number of bins, so its digest is built from one sorted array.
    """
    text = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("bin", F.round(value, 6).cast("decimal(20,6)").alias("v")))), lambda s: s["v"].cast("string")))
    one = curves.groupBy(*group, replicate).agg(
        F.count("*").alias("bins"), F.round(F.min("left_um"), 9).alias("lo"), F.round(F.max("right_um"), 9).alias("hi"), F.md5(text).alias("digest")
    )
    return one.groupBy(*group).agg(
        F.count("*").alias("replicates"), F.countDistinct(replicate).alias("distinct_ids"),
        F.countDistinct("digest").alias("distinct_inputs"), F.countDistinct("bins").alias("bin_counts"),
        F.countDistinct("lo", "hi").alias("ranges"),
    )


def table_digest(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Order-independent identity of a row set: count, sum and xor of per-row md5 integers."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    h = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows_n"), F.sum(h.cast("decimal(38,0)")).alias("digest_sum"), F.bit_xor(h).alias("digest_xor")
    )
