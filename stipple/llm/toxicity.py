"""Toxicity by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

Features of a text are the distinct words, word pairs and pairs with one word between, hashed to
2**BITS coordinates. Each coordinate has its own learning rate, and the L1 term keeps coordinates
at zero until their gradients have outweighed it, so the fitted weights are few; they are sent to
the tasks as one sparse array of at most 2**BITS numbers.

The model is fitted in one task on a bounded sample: the ``max_rows`` labelled documents with the
smallest hash of their id (default 10,000), each in its whole length. Scoring reads every
whole text. A document's score is the logistic value of the
sum of its features' weights.

Null and empty texts have no features and get the score of the bias. A null doc_id is held out
(it has no crc) and its row is scored. Repeated rows are scored each. Labels other than 0 and 1
and labels without a document are ignored. Without any usable label all scores are 0.5. Other
columns are never looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.llm.registry import named, table
from stipple.llm.shared import LOWER, Prefixes, byte_values, mixed, slices, with_short_batches, word_bounds

BITS = 20
MAX_ROWS = 10_000
THRESHOLD = 0.7
#: Signs at either end of a word that are not part of it.
EDGES = np.zeros(256, bool)
EDGES[[*b".,;:!?\"'()[]{}<>*#%$&|-_"]] = True


def features(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed coordinates of all rows' distinct features, and the n + 1 offsets of the rows."""
    data = LOWER[data]
    starts, ends, _ = word_bounds(data, at)
    for _ in range(3):
        starts = starts + ((ends - starts > 1) & EDGES[data[np.minimum(starts, len(data) - 1)]]) if len(data) else starts
        ends = ends - ((ends - starts > 1) & EDGES[data[ends - 1]]) if len(data) else ends
    rows = np.searchsorted(starts, at)
    h = Prefixes(byte_values(data)).part(starts, ends)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(rows))
    found, of = [h], [doc]
    for gap, step in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            found.append(mixed(h[:-gap] * np.uint64(step) + h[gap:])[same])
            of.append(doc[:-gap][same])
    low = (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64) | (np.concatenate(of) << bits)
    low = np.sort(low)
    low = low[np.r_[True, low[1:] != low[:-1]]] if len(low) else low
    return low & ((1 << bits) - 1), np.searchsorted(low, np.arange(len(at)) << bits)


def fit(rows: list[np.ndarray], labels: np.ndarray, *, bits: int = BITS, alpha: float = 3.0, beta: float = 1.0,
        l1: float = 10.0, l2: float = 1.0, passes: int = 6) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over the rows in the order given: coordinates and weights that are not zero, and the bias."""
    z, n, bias_z, bias_n = np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 0.0
    rate = 0.0
    for _ in range(passes):
        for x, y in zip(rows, labels):
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) > l1, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2), 0.0)
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha + l2)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            sigma = (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha
            z[x] = zx + g - sigma * w
            n[x] = nx + g * g
            rate = (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha
            bias_z, bias_n = bias_z + g - rate * bias, bias_n + g * g
    live = np.flatnonzero(np.abs(z) > l1)
    w = -(z[live] - np.sign(z[live]) * l1) / ((beta + np.sqrt(n[live])) / alpha + l2)
    return live, w, float(-bias_z / ((beta + np.sqrt(bias_n)) / alpha + l2))


def train(docs: DataFrame, labels: DataFrame, usable: Column, *, id_col: str, text_col: str, label_col: str,
          max_rows: int = MAX_ROWS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights fitted in one task on the labelled documents with the smallest id hashes among ``usable`` ones; labels without a document take no place."""
    marks = (labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
             .where(F.col("__y").isin(0, 1) & F.col("__id").isNotNull()).groupBy("__id").agg(F.max("__y").alias("__y")))
    marks = marks.join(docs.select(F.col(id_col).alias("__id")), "__id", "left_semi")
    chosen = (marks.where(usable).withColumn("__h", F.xxhash64("__id")).orderBy("__h", "__id").limit(max_rows))
    own = with_short_batches(docs).select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "__text"):
                x, to = features(data, at, bits)
                cells = [x[to[i] : to[i + 1]].astype(np.int32).tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(cells, pa.binary())],
                                                 names=["h", "y", "x"])

    sample = own.join(chosen, "__id").select("__text", "__h", "__y").mapInArrow(extract, "h long, y int, x binary")

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "y", "x"])
        live, w, bias = fit([np.frombuffer(x, np.int32) for x in group["x"]], group["y"].to_numpy(), bits=bits)
        return pd.DataFrame({"at": np.r_[-1, live], "w": np.r_[bias, w]})

    found = sample.groupBy(F.lit(0).alias("one")).applyInPandas(learn, "at int, w double").toPandas()
    bias = float(found.loc[found["at"] == -1, "w"].sum())
    found = found[found["at"] >= 0].sort_values("at")
    return found["at"].to_numpy(np.int64), found["w"].to_numpy(float), bias


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, text_col: str = "text",
           bits: int = BITS) -> DataFrame:
    """``docs`` with a column ``__score``; all of its rows and columns stay."""
    sent = with_short_batches(docs).sparkSession.sparkContext.broadcast(model)  # 2**bits numbers at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, w, bias = sent.value
        weight = np.zeros(1 << bits)
        weight[live] = w
        for batch in batches:
            for part, data, at in slices(batch, text_col):
                x, to = features(data, at, bits)
                total = np.r_[0.0, np.cumsum(weight[x])]
                score_ = 1.0 / (1.0 + np.exp(-np.clip(total[to[1:]] - total[to[:-1]] + bias, -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.round(score_, 9))],
                                                 names=[*part.schema.names, "__score"])

    fields = docs.select("*", F.lit(0.0).alias("__score")).schema
    return docs.mapInArrow(score, fields)


def learnable(id_col: str = "__id") -> Column:
    """Rows whose label may be learned: crc32 of the id as text is not 1 modulo 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, learnable(), id_col=id_col, text_col=text_col, label_col=label_col, max_rows=max_rows)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    held_out = F.coalesce(~learnable("doc_id"), F.lit(True))
    return scored(slim, model, text_col="__text").select(
        "doc_id", held_out.alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""
    model = train(docs, labels, learnable(), id_col=id_col, text_col=text_col, label_col="toxic")
    return scored(docs, model, text_col=text_col).where(F.col("__score") < threshold).select(docs.columns)


@named("op8_toxicity_ftrl")
def op8_toxicity_ftrl(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
