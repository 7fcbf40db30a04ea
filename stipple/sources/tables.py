"""Readers and writers of saved tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stipple.functions.columns import rounded
from stipple.session import ensure_checkpoint_dir


def scratch_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors can reach."""
    return f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Write the whole table as Parquet, partitioned ``by`` columns, and read it back in the same column order and types."""
    folder = scratch_folder(df.sparkSession)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder).select(*[F.col(f"`{c}`") for c in df.columns])


def write_csv(df: DataFrame, path: str, *, by: Sequence[str] = (), compression: str = "none") -> None:
    """Full-precision CSV: NULL is blank, nested columns become JSON."""
    nested = (T.MapType, T.ArrayType, T.StructType)
    flat = df.select(*[
        (F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name)).alias(f.name) for f in df.schema
    ])
    writer = flat.write.mode("errorifexists").option("header", True).option("nullValue", "").option("compression", compression)
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_curve_tables(curves: DataFrame, folder: str, *, by: Sequence[str]) -> None:
    """One CSV folder per combination of ``by``."""
    write_csv(curves, folder, by=by)


def read_curve_tables(
    spark: SparkSession, folder: str, *, value_columns: Sequence[str], id_columns: Mapping[str, str], by: Mapping[str, str]
) -> DataFrame:
    """Saved curves with explicit types; the folder names supply the ``by`` columns."""
    fields = [*[f"{c} {t}" for c, t in id_columns.items()], "bin int", *[f"{c} double" for c in value_columns],
              "left_um double", "right_um double"]
    schema = ", ".join([*fields, *[f"{c} {t}" for c, t in by.items()]])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(folder)


def check_saved_curves(saved: DataFrame, keys: Sequence[str], value: str, *, n_bins: int) -> DataFrame:
    """Per saved curve: bins, mass, increasing edges and the verdict."""
    out = saved.groupBy(*keys).agg(
        F.count("*").alias("bins"), rounded(F.sum(value)).alias("mass"),
        F.bool_and(F.col("right_um") > F.col("left_um")).alias("increasing"),
    )
    return out.withColumn("valid", (F.col("bins") == n_bins) & F.col("increasing"))
