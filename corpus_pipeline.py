"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing and packing, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller writes as Parquet and
rereads as the next stage's ``docs``. All but the last return the columns of ``documents``; the last
returns one row per packed piece. ``run`` does the same on tables in the shared checkpoint folder.
The toxicity stage uses a model, so the rows have no SQL twin; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.llm.exact import drop_copies
from stipple.llm.hamming import near_duplicates
from stipple.llm.mixture import sample_to_targets
from stipple.llm.packing import pack
from stipple.llm.shared import written
from stipple.llm.toxicity import drop_toxic

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest doc_id; rows without an id stay.

    The list of ids to drop is joined, not the list to keep: it is the shorter one.
    """
    out = near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(written(out), "doc_id", "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target shares of sources, languages and topics."""
    return sample_to_targets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing),
          ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
