"""Exact dedup by progressive refinement: length, then a hash of the beginning, then a hash of the whole.

Groups that a cheap key already separates never reach a dearer one: the full text is hashed only
in groups of two or more rows of equal length and beginning. Each refinement is a partial count,
so a group that holds a third of all rows is combined before it moves.

Null texts count as empty texts. A null doc_id is an id of its own, smaller than all others. Rows
repeated in doc_id and text are one document. Other columns are never looked at, so clashing names
do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.llm.registry import named, table
from stipple.llm.shared import written

PREFIX_CHARS = 256


def cheap_keys(text: Column) -> list[Column]:
    return [F.octet_length(text).alias("__len"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("__head")]


def full_key(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256).alias("__full")


def copy_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per group of two or more equal texts: __len, __head, __full, keep_id, group_size."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), *cheap_keys(text))
    lengths = base.groupBy("__len").agg(F.count("*").alias("__n")).where("__n > 1").select("__len")
    heads = (base.drop("__text", "__id").join(lengths, "__len", "left_semi")
             .groupBy("__len", "__head").agg(F.count("*").alias("__n")).where("__n > 1").select("__len", "__head"))
    alive = base.join(written(heads), ["__len", "__head"], "left_semi")
    hashed = alive.select("__id", "__len", "__head", full_key(F.col("__text")))
    return (hashed.groupBy("__len", "__head", "__full", "__id").agg(F.count("*").alias("__rows"))
            .groupBy("__len", "__head", "__full")
            .agg(F.max("__id").alias("keep_id"), F.count("*").alias("group_size"), F.sum("__rows").alias("__rows"))
            .where("__rows > 1").drop("__rows"))


def exact_decisions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), *cheap_keys(text), full_key(text)).distinct()
    found = rows.join(written(copy_groups(docs, id_col=id_col, text_col=text_col)), ["__len", "__head", "__full"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("__full").alias("text_sha256"))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without copies: of equal texts the row with the largest id stays, once; all columns stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    groups = written(copy_groups(docs, id_col=id_col, text_col=text_col))
    heads = groups.select("__len", "__head").distinct()
    keyed = docs.select("*", *cheap_keys(text))
    apart = keyed.join(heads, ["__len", "__head"], "left_anti").select(docs.columns)
    alive = keyed.join(heads, ["__len", "__head"], "left_semi")
    # never null, or the planner would ask for hashes that are not null before the semi join
    alive = alive.select("*", F.coalesce(full_key(text), F.lit("")).alias("__full"))
    single = alive.join(groups, ["__len", "__head", "__full"], "left_anti").select(docs.columns)
    chosen = (alive.join(groups, ["__len", "__head", "__full"])
              .where(F.col(id_col).eqNullSafe(F.col("keep_id"))).dropDuplicates(["__len", "__head", "__full"]))
    return apart.unionByName(single).unionByName(chosen.select(docs.columns))


@named("op6_exact_dedup", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(DISTINCT doc_id) AS group_size FROM d GROUP BY t)
SELECT DISTINCT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""")
def op6_exact_dedup(spark, sf_dir):
    return exact_decisions(table(spark, sf_dir, "documents"))
