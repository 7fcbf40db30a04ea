"""Texts that stand apart are never hashed whole."""

from pyspark.sql import functions as F
from test_contracts import DOCS

from stipple.llm import exact


def test_texts_apart_are_not_hashed_whole(spark, monkeypatch):
    @F.udf("string")
    def full(text):
        if text.startswith("apart"):
            raise ValueError("hashed: " + text)
        return text

    monkeypatch.setattr(exact, "full_key", lambda text: full(text).alias("__full"))
    long_ = "x" * 300
    rows = [(1, "apart one"), (2, "apart two"), (3, "apart, of a length of its own"), (4, "copy"), (5, "copy"), (6, long_ + "a"), (7, long_ + "b"), (8, long_ + "b")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS)
    assert sorted(r["doc_id"] for r in exact.drop_copies(docs).collect()) == [1, 2, 3, 5, 6, 8]
