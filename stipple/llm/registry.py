"""Named queries of this subpackage. ``queries()`` and ``oracle_sql()`` feed the driver's entry module."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MODULES = ("exact", "packing", "hamming", "toxicity", "mixture", "divergence", "templates", "recompression", "fuzzy_lines", "suffixes", "whitening", "prefix_trie", "small_world", "pipeline_query")


@dataclass(frozen=True)
class Named:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Named] = {}


def named(name: str, sql: str | None = None):
    """Register ``run(spark, sf_dir)`` under ``name`` with its DuckDB twin, where one exists."""

    def wrap(run):
        ENTRIES[name] = Named(run, sql)
        return run

    return wrap


def load() -> dict[str, Named]:
    for module in MODULES:
        importlib.import_module(f"stipple.llm.{module}")
    return ENTRIES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
