"""Fuzzy line dedup by MinHash over character shingles.

Lines with a word are taken trimmed; equal ones are one line from the start. A line's set holds its
distinct runs of ``SHINGLE`` characters (a shorter line is one run). Its signature comes from one
permutation: hashes are split into 32 ranges and the least of each range is a minimum, an empty range
taking the next one's. Bands of 4 minima are keys: lines with a similarity of 0.85 share one of
the 8 keys with a probability of 0.997. In each key all lines are compared with the smallest one. Keys whose
lines are then in several components are dealt into blocks, and each two blocks meet in one group: lines of
different components are compared, and what links them leaves as a tree. So one pass ends every key, whatever
its size, and no task holds a whole key. Links are confirmed on the full sets. Components come from
distributed union-find, and of each component the first line by (doc_id, line number) stays. A line is known by 128 bits of its content.

Signatures and comparisons are made by numpy in tasks: array functions took one to two microseconds a character. All
else is DataFrame operations. Keys are made distinct before they move on, so equal lines never multiply.

Null and empty texts have no lines; lines of white space are kept and not counted. A null doc_id comes
after all others. Rows repeated in doc_id and text are one document. Other columns are never looked at. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.llm.registry import named, table
from stipple.llm.shared import (Prefixes, Trees, byte_values, components, dealt, groups, mixed, slices, with_short_batches,
                                written)

SHINGLE = 10
PERCENT = 80
RANGES = 32
BAND = 4
BLOCK = 256  # lines of a band in one block


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key of the row, no, id and line of every line with a word; no counts from 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("key"), text.alias("t"))
    split = rows.select("doc_id", "key", F.posexplode(F.split("t", "\n", -1)).alias("no", "line"))
    trimmed = F.btrim("line", F.lit(" \t\n\x0b\x0c\r"))
    return split.select("doc_id", "key", "no", trimmed.alias("line")).where("line <> ''").select(
        "doc_id", "key", "no", F.unhex(F.md5("line")).alias("id"), "line")


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every character run of every line, and the line that each belongs to."""
    edge = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]  # characters begin here
    first = np.searchsorted(edge, at)
    counts = np.maximum(1, np.diff(first) - SHINGLE + 1)
    line = np.repeat(np.arange(len(counts)), counts)
    start = first[line] + np.arange(len(line)) - (np.cumsum(counts) - counts)[line]
    end = np.minimum(start + SHINGLE, first[line + 1])
    return Prefixes(byte_values(data)).part(edge[start], edge[end]), line


def minima(values: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """Per line the least hash of each of RANGES equal ranges of 64-bit values; an empty range takes the next one's, going round."""
    empty = np.iinfo(np.uint64).max
    least = np.full(n * RANGES, empty, np.uint64)
    np.minimum.at(least, line * RANGES + (values >> np.uint64(59)).astype(np.int64), values)
    least = least.reshape(n, RANGES)
    for k in range(2 * RANGES - 1, -1, -1):
        here, after = least[:, k % RANGES], least[:, (k + 1) % RANGES]
        least[:, k % RANGES] = np.where(here == empty, after, here)
    return least


def band_keys(lines: DataFrame) -> DataFrame:
    """(band key, id) of every line."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "line"):
                m = minima(*shingles(data, at), part.num_rows).reshape(part.num_rows, -1, BAND)
                keys = np.tile(np.arange(m.shape[1], dtype=np.uint64), (part.num_rows, 1))
                for k in range(BAND):
                    keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + m[:, :, k])
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), ids], names=["band", "id"])

    return with_short_batches(lines).select("id", "line").mapInArrow(file, "band long, id binary")


def line_sets(column) -> list[np.ndarray]:
    """The distinct shingle hashes of each line, in order."""
    out, batch = [], pa.RecordBatch.from_arrays([column], names=["line"])
    for part, data, at in slices(batch, "line"):
        values, line = shingles(data, at)
        order = np.lexsort((values, line))
        values, line = values[order], line[order]
        new = np.r_[True, (values[1:] != values[:-1]) | (line[1:] != line[:-1])]
        out += np.split(values[new], np.searchsorted(line[new], np.arange(1, part.num_rows)))
    return out


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def texts_of(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    return written(lines.select("id", "line").join(wanted, "id", "left_semi").distinct())


def confirmed(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs with 100 * intersection >= percent * union on the whole sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(x, y, percent) for x, y in zip(line_sets(batch.column(2)), line_sets(batch.column(3)))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = texts_of(lines, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b"))
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a binary, b binary")


def met_in_blocks(members: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Links between different components of a band, as trees; members: band, id, component, n."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["band", "i", "j"]):
            group = group.combine_chunks()
            ids, own = group["id"].to_pylist(), group["own"].to_numpy()
            across = group["i"][0] != group["j"][0]
            sets = line_sets(group["line"].combine_chunks())
            sizes = np.array([len(x) for x in sets])
            counts = np.stack([np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=256) for x in sets]).astype(np.int32)
            trees, found = Trees(group["component"].to_pylist()), []
            for k in range(len(ids) - 1):
                rest = np.arange(k + 1, len(ids))
                roots = trees.roots()
                rest = rest[(roots[rest] != roots[k]) & ((own[rest] != own[k]) | (not across))]
                most = np.minimum(counts[rest], counts[k]).sum(axis=1)  # no intersection is larger
                rest = rest[100 * most >= percent * (sizes[rest] + sizes[k] - most)]
                for m in rest:
                    if trees.root(k) != trees.root(m) and alike(sets[k], sets[m], percent):
                        trees.join(k, m)
                        found.append((ids[k], ids[m]))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    texts = texts_of(lines, members.select("id").distinct())
    blocks = dealt(members.join(texts, "id"), ["band"], BLOCK)
    return blocks.select("band", "i", "j", "own", "id", "component", "line").mapInArrow(meet, "a binary, b binary")


def line_components(lines: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of every line id that is linked to another."""
    keys = written(band_keys(lines).distinct())
    shared = keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keys.join(shared, "band"))
    heads = members.groupBy("band").agg(F.min("id").alias("head"))
    pairs = members.join(heads, "band").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    found = components(written(confirmed(written(pairs.distinct()), lines, percent)))
    placed = members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    left = written(placed.join(split.select("band"), "band", "left_semi"))
    more = written(met_in_blocks(left, lines, percent))
    return found if more.isEmpty() else components(more.union(found.select("node", "component")))


def line_decisions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, key, no, id, component, kept of every line with a word."""
    lines = lines_of(docs, id_col, text_col)
    found = line_components(lines, percent)
    slim = lines.select("doc_id", "key", "no", "id").join(found.withColumnRenamed("node", "id"), "id", "left")
    slim = written(slim.select("doc_id", "key", "no", "id", F.coalesce("component", "id").alias("component")))
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key", "no")
    firsts = slim.groupBy("component").agg(F.min(place).alias("first"))
    return slim.join(firsts, "component").select("doc_id", "key", "no", "id", "component", (F.col("first") == place).alias("kept"))


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed and the numbers of the removed lines in order."""
    judged = line_decisions(docs, id_col=id_col, text_col=text_col).distinct().groupBy("doc_id", "key").agg(
        F.count("*").alias("n_lines"), F.sum((~F.col("kept")).cast("long")).alias("n_removed"),
        F.sort_array(F.collect_list(F.when(~F.col("kept"), F.col("no")))).alias("removed_lines"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.col(id_col).cast("long")
    rows = docs.select(doc.alias("doc_id"), F.xxhash64(doc, text).alias("key")).distinct()
    return rows.join(judged.drop("doc_id"), "key", "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"))


@named("op4_fuzzy_lines")
def op4_fuzzy_lines(spark, sf_dir):
    return line_report(table(spark, sf_dir, "documents"))
