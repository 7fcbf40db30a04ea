"""Labels without a document take no place of the sample."""

from pyspark.sql import functions as F
from test_contracts import DOCS

from stipple.llm import toxicity


def test_labels_without_a_document_take_no_place(spark):
    docs = spark.createDataFrame([(i, "vile rotten" if i % 2 else "fine day", "en", "s", 0) for i in range(60)], DOCS)
    own = spark.createDataFrame([(i, 0, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    strange = spark.range(1000, 6000).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"), F.lit(1).alias("toxic"))
    want = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, own, max_rows=30).collect()}
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, own.unionByName(strange), max_rows=30).collect()}
    assert got == want and len(set(want.values())) > 1
