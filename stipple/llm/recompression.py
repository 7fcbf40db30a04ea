"""Repeated word passages by recompression.

A text's words are symbols. Round after round, runs of an equal symbol become one symbol and then
adjacent pairs (left, right) become one symbol, where a bit of a symbol's name says which side it can
take in that round. A symbol's name is a 64-bit function of the names it is made of, so all tasks name
alike and equal passages get equal symbols but for a few at either end. A symbol that spans at least
``SPAN`` words is final: it cuts the text like a mark that depends on its content alone. Runs are cut
into symbols of at least that span, so a long run has the same symbols wherever it begins.

Spark then counts the final symbols by document. A symbol in two or more documents reveals a possible
repeat. The stretch of window starts before each symbol is compared with that of other documents as a
whole (its words and the 49 after it), which settles the inside of long repeats, and window by window where the
stretch is met for the first time, which settles their ends. All comparisons are minimum aggregates
of document ids by content and joins back, so a passage in any number of documents stays spread.

A word goes when a window over it also starts in a document with a smaller doc_id. Null and empty
texts have no words. A null doc_id counts as larger than any other; several such rows are one
document in that respect, as are rows repeated in doc_id, whose texts are judged each. Other columns are never
looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.llm.registry import named, table
from stipple.llm.shared import Prefixes, byte_values, mixed, slices, with_short_batches, word_bounds, written

WINDOW = 50
SPAN = 6
ROUNDS = 16
LAST = (1 << 63) - 1


def symbols(h: np.ndarray, rows: np.ndarray, span: int = SPAN, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Final symbols of all rows: name, first word and end (word numbers over all rows)."""
    name = h.copy()
    start = np.arange(len(h))
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    width = np.ones(len(h), np.int64)
    for r in range(rounds):
        if not len(name):
            break
        free = width < span
        # runs of a free symbol, cut into symbols of `span` words or a little more
        head = np.r_[True, (name[1:] != name[:-1]) | (row[1:] != row[:-1]) | ~free[1:]]
        first = np.flatnonzero(head)
        if len(first) < len(name):
            within = np.arange(len(name)) - np.repeat(first, np.diff(np.r_[first, len(name)]))
            head |= within % -(-span // width) == 0
            first = np.flatnonzero(head)
            times = np.diff(np.r_[first, len(name)])
            base = name[first]
            name = np.where(times > 1, mixed(base * np.uint64(0x9E3779B97F4A7C15) + times.astype(np.uint64)), base)
            width, start, row = width[first] * times, start[first], row[first]
            free = width < span
        side = (mixed(name + np.uint64(0x1000 + r)) >> np.uint64(40)) & np.uint64(1) == 1
        left = np.flatnonzero(free[:-1] & free[1:] & ~side[:-1] & side[1:] & (row[:-1] == row[1:]))
        if len(left):
            name[left] = mixed(mixed(name[left]) * np.uint64(0xC2B2AE3D27D4EB4F) + name[left + 1])
            width[left] += width[left + 1]
            keep = np.ones(len(name), bool)
            keep[left + 1] = False
            name, width, start, row = name[keep], width[keep], start[keep], row[keep]
    done = width >= span
    return name[done], start[done], start[done] + width[done]


def stretches(start: np.ndarray, end: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol the window starts [lo, hi) after the one before it up to its own first word, and its row."""
    row = np.searchsorted(rows, start, "right") - 1
    before = np.r_[-1, start[:-1]]
    fresh = np.r_[True, row[1:] != row[:-1]] if len(row) else np.empty(0, bool)
    lo = np.maximum(np.where(fresh, rows[row], before + 1), end - window) if len(row) else start
    hi = np.minimum(start, rows[row + 1] - window) + 1 if len(row) else start
    return lo, hi, row


def laid_out(data: np.ndarray, at: np.ndarray):
    begin, stop, rows = word_bounds(data, at)
    h = Prefixes(byte_values(data)).part(begin, stop)
    return begin, stop, rows, h


def marked(docs: DataFrame, window: int) -> DataFrame:
    """doc, key, slot, name, stretch of every final symbol; stretch is NULL where no window starts in it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "__text"):
                _, _, rows, h = laid_out(data, at)
                name, start, end = symbols(h, rows)
                lo, hi, row = stretches(start, end, rows, window)
                some = hi > lo
                content = Prefixes(h).part(np.where(some, lo, 0), np.where(some, hi + window - 1, 0))
                doc = part.column(0).to_numpy(zero_copy_only=False)[row]
                key = part.column(1).to_numpy(zero_copy_only=False)[row]
                slot = np.arange(len(row)) - np.searchsorted(row, row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc), pa.array(key), pa.array(slot.astype(np.int32)), pa.array(name.view(np.int64)),
                     pa.array(content.view(np.int64), mask=~some)], names=["doc", "key", "slot", "name", "stretch"])

    return docs.mapInArrow(emit, "doc long, key long, slot int, name long, stretch long")


def windows_of(docs: DataFrame, window: int) -> DataFrame:
    """(doc, key, at, content) of the windows that start in the listed ``open`` stretches of each text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "__text"):
                _, _, rows, h = laid_out(data, at)
                _, start, end = symbols(h, rows)
                lo, hi, row = stretches(start, end, rows, window)
                first = np.searchsorted(row, np.arange(part.num_rows))
                chosen = [np.asarray(o, np.int64) + first[r] for r, o in enumerate(part.column(3).to_pylist())]
                chosen = np.concatenate(chosen) if chosen else np.empty(0, np.int64)
                size = np.maximum(hi[chosen] - lo[chosen], 0)
                begin = np.repeat(lo[chosen] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                of = np.repeat(row[chosen], size)
                content = Prefixes(h).part(begin, begin + window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.column(0).to_numpy(zero_copy_only=False)[of]),
                     pa.array(part.column(1).to_numpy(zero_copy_only=False)[of]),
                     pa.array((begin - rows[of]).astype(np.int64)), pa.array(content.view(np.int64))],
                    names=["doc", "key", "at", "content"])

    return docs.mapInArrow(emit, "doc long, key long, at long, content long")


def passages_removed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    base = docs.select(doc.alias("doc"), F.xxhash64(doc, text).alias("key"), text.alias("__text"))
    marks = marked(with_short_batches(base), window)
    shared = written(marks.groupBy("name").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("name"))
    hits = written(marks.select("name", "key", "slot").join(shared, "name", "left_semi").select("key", "slot"))
    # a stretch is worth a look when one of the symbols that its windows can hold is shared
    reach = F.explode(F.sequence(F.col("slot") - window // SPAN, F.col("slot"))).alias("slot")
    near = hits.select("key", reach).where("slot >= 0").distinct()
    looked = written(marks.where("stretch is not null").select("stretch", "doc", "key", "slot").join(near, ["key", "slot"], "left_semi"))
    firsts = looked.groupBy("stretch").agg(F.min("doc").alias("first"))
    judged = written(looked.join(firsts, "stretch").select("key", "slot", (F.col("first") < F.col("doc")).alias("covered")))
    open_ = judged.where("not covered").groupBy("key").agg(F.collect_set("slot").alias("open"))
    windows = written(windows_of(base.join(open_, "key").select("doc", "key", "__text", "open"), window))
    earliest = windows.groupBy("content").agg(F.min("doc").alias("first"))
    late = windows.join(earliest, "content").where("first < doc").groupBy("key").agg(F.collect_set("at").alias("starts"))
    whole = judged.where("covered").groupBy("key").agg(F.collect_set("slot").alias("slots"))
    plan = written(late.join(whole, "key", "full_outer"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "__text"):
                begin, stop, rows, h = laid_out(data, at)
                _, start, end = symbols(h, rows)
                lo, hi, row = stretches(start, end, rows, window)
                first = np.searchsorted(row, np.arange(part.num_rows))
                mark = np.zeros(len(h) + 1, np.int64)
                for r, (slots, starts) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    if slots:
                        s = np.array(slots, np.int64) + first[r]
                        np.add.at(mark, lo[s], 1)
                        np.add.at(mark, hi[s] + window - 1, -1)
                    if starts:
                        s = np.array(starts, np.int64) + rows[r]
                        np.add.at(mark, s, 1)
                        np.add.at(mark, s + window, -1)
                gone = np.cumsum(mark)[:-1] > 0
                removed, sha = [], []
                raw = data.tobytes()
                for r in range(part.num_rows):
                    words = range(rows[r], rows[r + 1])
                    cut = gone[rows[r] : rows[r + 1]]
                    removed.append(int(cut.sum()))
                    if removed[-1]:
                        kept = b" ".join([raw[begin[i] : stop[i]] for i in words if not gone[i]])
                    else:
                        kept = b" ".join(raw[at[r] : at[r + 1]].split())
                    sha.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(rows)), pa.array(removed, pa.int64()), pa.array(sha)],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    id_of = F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id")
    return (base.join(plan, "key", "left").select(id_of, "__text", "slots", "starts")
            .mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string"))


@named("op9_recompression_dedup")
def op9_recompression_dedup(spark, sf_dir):
    return passages_removed(table(spark, sf_dir, "documents"))
