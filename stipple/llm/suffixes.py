"""Repeated byte strings by suffix arrays.

``repeats_removed`` finds 400-byte strings that start in two places. Every start has an anchor: the smallest rolling
hash of the next 96 places, the last of equal ones. An anchor depends on the bytes of the string alone, so equal strings have
anchors at the same distance with 304 equal bytes after them. The starts of one anchor are a stretch, and the hash of
those 304 bytes names its bucket. Buckets with one stretch hold no repeat. Stretches whose bytes (with the 399 after the last start)
occur twice as a whole are repeats as a whole, and one of them stays for comparison. Buckets with different stretches move
their bytes, each stretch to one task, which sorts the suffixes of whole buckets by their first 400 bytes; a start repeats when its
neighbour in that order has the same 400 bytes. Names only bring strings together, so equal names of different bytes do no harm.
A bucket of more than ``crowd`` different stretches isn't sorted in one task: the digests of its 400-byte strings are counted instead.

``suffix_ranks`` orders the suffixes of many strings across tasks (difference cover modulo 3). Positions 1 and 2 modulo 3 are sampled; their
triples of symbols are sorted and replaced by names, and the two sequences of names are strings of
the next level, a third as long each. When a name covers ``depth`` symbols it is a rank. On the way back
the remaining suffixes are merged by two sorts: beside those at 1 modulo 3 by (symbol, rank of the next)
and beside those at 2 modulo 3 by (symbol, symbol, rank of the one after). A rank is a count of smaller
suffixes: sorts are range partitions whose tasks add the counts of the tasks before them.
A string stays one row; only triples and keys move, combined by value first.

Texts are UTF-8; null and empty ones have no bytes. Rows with a null doc_id or a repeated doc_id are
documents like any other; rows equal in doc_id and text repeat each other. Other columns are never looked at. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.llm.registry import named, table
from stipple.llm.shared import Prefixes, byte_values, slices, with_short_batches, written

WIDTH = 400
ROLL = 16
REACH = 96
CROWD = 4096  # different stretches of a bucket that one task sorts
SORTED_BYTES = 1 << 20  # bytes of whole buckets whose suffixes are sorted at once


# ---- the suffix array -------------------------------------------------------------------------


def counted_before(keys: DataFrame, by: list[str], counts: list[str]) -> DataFrame:
    """Distinct ``by`` with, for each of ``counts``, its sum over all smaller ``by`` under ``before_<name>``."""
    spark = keys.sparkSession
    totals = keys.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = totals.repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    width = len(by)

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * len(counts)
        for batch in batches:
            out = []
            for k in range(len(counts)):
                c = batch.column(width + k).to_numpy(zero_copy_only=False)
                upto = np.cumsum(c) + sums[k]
                out.append(pa.array(upto - c))
                sums[k] = int(upto[-1]) if len(upto) else sums[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *[f"before_{c}" for c in counts]])

    fields = ", ".join([f"{c} long" for c in [*by, *counts]] + [f"before_{c} long" for c in counts])
    local = written(ordered.mapInArrow(running, fields).withColumn("task", F.spark_partition_id()))
    sizes = local.groupBy("task").agg(*[F.sum(c).alias(c) for c in counts]).orderBy("task").collect()  # a row for each task
    skip, rows = [0] * len(counts), []
    for r in sizes:
        rows.append((r["task"], *skip))
        skip = [a + r[c] for a, c in zip(skip, counts)]
    if not rows:
        rows = [(0, *skip)]
    offsets = F.broadcast(spark.createDataFrame(rows, "task int, " + ", ".join(f"skip_{c} long" for c in counts)))
    return local.join(offsets, "task").select(*by, *[(F.col(f"before_{c}") + F.col(f"skip_{c}")).alias(f"before_{c}") for c in counts])


def mapped(strings: DataFrame, fn, fields: str) -> DataFrame:
    """``fn`` on each row's numpy lists; yields the row's outputs in the order of ``fields``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            outs = [o for r in rows for o in fn(r)]
            columns = list(zip(*outs)) if outs else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    pairs = [f.strip().split(" ", 1) for f in fields.split(", ")]
    names = [p[0] for p in pairs]
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<array<long>>": pa.list_(pa.list_(pa.int64()))}
    types = [kinds[p[1]] for p in pairs]
    return strings.mapInArrow(go, fields)


def padded(s: list[int]) -> np.ndarray:
    return np.r_[np.asarray(s, np.int64), 0, 0, 0]


def suffix_ranks(strings: DataFrame, depth: int, covered: int = 1) -> DataFrame:
    """(seg, ranks) for (seg, s): ``s`` are lists of symbols from 1 up, each covering ``covered`` units.

    A rank orders a suffix among those of all strings by its first ``depth`` units at least; a
    string's end is smaller than any symbol. Suffixes equal so far have equal ranks.
    """
    if covered >= depth:
        return strings.withColumnRenamed("s", "ranks")

    def triples(row):
        for s in row["s"]:
            t = padded(s)
            i = np.arange(len(s))
            i = i[i % 3 > 0]
            yield from zip(t[i].tolist(), t[i + 1].tolist(), t[i + 2].tolist(), [1] * len(i))

    if covered == 1:
        shorter = mapped(strings, lambda row: [(row["seg"], [v for s in row["s"] for v in packed(padded(s), len(s))])],
                         "seg long, s array<array<long>>")
    else:
        keys = mapped(strings, triples, "a long, b long, c long, n long")
        names = written(counted_before(keys, ["a", "b", "c"], ["n"]).withColumn("name", F.col("before_n") + 1))

        def places(row):
            for k, s in enumerate(row["s"]):
                t = padded(s)
                for m in (1, 2):
                    for j, i in enumerate(range(m, len(s), 3)):
                        yield row["seg"], 2 * k + m - 1, j, int(t[i]), int(t[i + 1]), int(t[i + 2])

        placed = mapped(strings, places, "seg long, sub long, j long, a long, b long, c long").join(names, ["a", "b", "c"])
        lists = placed.groupBy("seg", "sub").agg(F.sort_array(F.collect_list(F.struct("j", "name"))).alias("l"))
        lists = lists.groupBy("seg").agg(F.collect_list(F.struct("sub", F.col("l.name").alias("v"))).alias("subs"))

        def whole(row):
            found = {x["sub"]: x["v"] for x in row["subs"] or []}
            return [(row["seg"], [found.get(k, []) for k in range(2 * len(row["s"]))])]

        shorter = mapped(strings.join(lists, "seg", "left"), whole, "seg long, s array<array<long>>")
    shorter = written(shorter)
    sampled = suffix_ranks(shorter, depth, 3 * covered)
    both = written(strings.join(sampled.withColumnRenamed("ranks", "r"), "seg"))

    def sample_rank(row, k: int, n: int) -> np.ndarray:
        rank = np.zeros(n + 3, np.int64)  # past the end: smaller than any suffix
        for m in (1, 2):
            own = np.asarray(row["r"][2 * k + m - 1], np.int64)
            rank[m : n : 3] = own + 1
        return rank

    # ranks of the next level become counts of smaller sampled suffixes
    def sample_keys(row):
        for k, s in enumerate(row["s"]):
            rank = sample_rank(row, k, len(s))
            i = np.arange(len(s))
            yield from zip(rank[i[i % 3 > 0]].tolist(), [1] * int((i % 3 > 0).sum()))

    order = counted_before(mapped(both, sample_keys, "r long, n long"), ["r"], ["n"]) if 3 * covered >= depth else None

    def first_keys(row):
        for k, s in enumerate(row["s"]):
            t, rank = padded(s), sample_rank(row, k, len(s))
            i = np.arange(len(s))
            i = i[i % 3 < 2]
            yield from zip(t[i].tolist(), rank[i + 1].tolist(), (i % 3 == 0).astype(int).tolist(), (i % 3 == 1).astype(int).tolist())

    def second_keys(row):
        for k, s in enumerate(row["s"]):
            t, rank = padded(s), sample_rank(row, k, len(s))
            i = np.arange(len(s))
            i = i[i % 3 != 1]
            yield from zip(t[i].tolist(), t[i + 1].tolist(), rank[i + 2].tolist(), (i % 3 == 0).astype(int).tolist(), (i % 3 == 2).astype(int).tolist())

    one = written(counted_before(mapped(both, first_keys, "a long, r long, n0 long, n1 long"), ["a", "r"], ["n0", "n1"]))
    two = written(counted_before(mapped(both, second_keys, "a long, b long, r long, n0 long, n2 long"), ["a", "b", "r"], ["n0", "n2"]))

    def first_places(row):
        for k, s in enumerate(row["s"]):
            t, rank = padded(s), sample_rank(row, k, len(s))
            for i in range(len(s)):
                if i % 3 < 2:
                    yield row["seg"], k, i, int(rank[i]), int(t[i]), int(rank[i + 1])

    def second_places(row):
        for k, s in enumerate(row["s"]):
            t, rank = padded(s), sample_rank(row, k, len(s))
            for i in range(len(s)):
                if i % 3 != 1:
                    yield row["seg"], k, i, int(rank[i]), int(t[i]), int(t[i + 1]), int(rank[i + 2])

    p1 = mapped(both, first_places, "seg long, k long, i long, own long, a long, r long").join(one, ["a", "r"])
    p2 = mapped(both, second_places, "seg long, k long, i long, own long, a long, b long, r long").join(two, ["a", "b", "r"])
    if order is not None:
        order = written(order.select(F.col("r").alias("own"), F.col("before_n").alias("less")))
        p1, p2 = p1.join(order, "own", "left"), p2.join(order, "own", "left")
    else:
        p1, p2 = p1.withColumn("less", F.col("own") - 1), p2.withColumn("less", F.col("own") - 1)
    zero, less = F.col("i") % 3 == 0, F.coalesce("less", F.lit(0))
    p1 = p1.select("seg", "k", "i", F.when(zero, F.col("before_n0") + F.col("before_n1")).otherwise(less + F.col("before_n0")).alias("v"))
    p2 = p2.select("seg", "k", "i", F.when(zero, F.col("before_n2")).otherwise(less + F.col("before_n0")).alias("v"))
    ranks = p1.union(p2).groupBy("seg", "k", "i").agg(F.sum("v").alias("v"))
    lists = ranks.groupBy("seg", "k").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("l"))
    lists = lists.groupBy("seg").agg(F.collect_list(F.struct("k", F.col("l.v").alias("v"))).alias("subs"))

    def ranked(row):
        found = {x["k"]: x["v"] for x in row["subs"] or []}
        return [(row["seg"], [found.get(k, []) for k in range(len(row["s"]))])]

    return written(mapped(strings.join(lists, "seg", "left"), ranked, "seg long, ranks array<array<long>>"))


def packed(t: np.ndarray, n: int) -> list[list[int]]:
    """Names of the sampled triples of symbols below 1024: the triples themselves, written as one number."""
    out = []
    for m in (1, 2):
        i = np.arange(m, n, 3)
        out.append(((t[i] * 1024 + t[i + 1]) * 1024 + t[i + 2] + 1).tolist())
    return out


# ---- repeated strings -------------------------------------------------------------------------


def anchors(values: Prefixes) -> np.ndarray:
    """For every place with REACH rolling hashes ahead of it, that of the smallest, the last of equal ones."""
    h = values.sums[ROLL:] - values.sums[:-ROLL]
    h *= values.down[: len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    n = len(h) - REACH + 1
    if n < 1:
        return np.empty(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    h |= low  # a place below the hash, later ones smaller
    h -= np.arange(len(h), dtype=np.uint64)
    blocks = np.r_[h, np.full(-len(h) % REACH, ~np.uint64(0))].reshape(-1, REACH)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()  # to the end of the block
    behind = np.minimum.accumulate(blocks, axis=1).ravel()  # from its beginning
    return (low - (np.minimum(ahead[:n], behind[REACH - 1 : REACH - 1 + n]) & low)).astype(np.int64)


def stretches(values: Prefixes, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every anchor of all rows: its place, its starts [lo, hi) (places over all rows) and its row."""
    place = anchors(values)
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), np.maximum(size - width + 1, 0))
    begin = np.cumsum(np.maximum(size - width + 1, 0)) - np.maximum(size - width + 1, 0)
    start = np.arange(len(row)) - begin[row] + at[row]
    place = place[start]
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][: len(place)])
    last = np.r_[new[1:], len(place)][: len(new)] - 1
    return place[new], start[new], start[last] + 1, row[new]


def marked(docs: DataFrame, width: int) -> DataFrame:
    """key, slot, name and stretch (the hash of its bytes) of every anchor."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "__text"):
                values = Prefixes(byte_values(data))
                place, lo, hi, row = stretches(values, at, width)
                key = part.column(0).to_numpy(zero_copy_only=False)[row]
                slot = (np.arange(len(row)) - np.searchsorted(row, row)).astype(np.int32)
                name, content = values.part(place, place + width - REACH), values.part(lo, hi + width - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(slot), pa.array(name.view(np.int64)), pa.array(content.view(np.int64))],
                    names=["key", "slot", "name", "stretch"])

    return docs.select("key", "__text").mapInArrow(emit, "key long, slot int, name long, stretch long")


def opened(docs: DataFrame, width: int) -> DataFrame:
    """name, key, begin, bytes and flags of the stretches listed in ``open`` of each text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "__text"):
                values = Prefixes(byte_values(data))
                place, lo, hi, row = stretches(values, at, width)
                lists = part.column(2)
                wanted = lists.flatten()
                of = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                k = np.searchsorted(row, of) + wanted.field("slot").to_numpy(zero_copy_only=False)
                name, raw = values.part(place[k], place[k] + width - REACH), data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), part.column(0).take(pa.array(of)), pa.array(lo[k] - at[of]),
                     pa.array([raw[i:j] for i, j in zip(lo[k].tolist(), (hi[k] + width - 1).tolist())], pa.binary()),
                     wanted.field("covered"), wanted.field("crowded")],
                    names=["name", "key", "begin", "bytes", "covered", "crowded"])

    return docs.select("key", "__text", "open").mapInArrow(
        emit, "name long, key long, begin long, bytes binary, covered boolean, crowded boolean")


def prefix_ranks(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Ranks of the suffixes with ``width`` bytes of each string, one after another; equal where those bytes are.

    Ranks by the first 8 bytes are doubled: a rank by 2 n bytes is that of the pair of ranks by n bytes, n places apart.
    ``at`` holds the offsets of the strings, none of which is shorter than ``width``.
    """
    size = np.diff(at)
    ahead = np.arange(len(data)) - np.repeat(at[:-1], size) - np.repeat(size - width, size)  # beyond the last start, where positive
    word = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    for step in (1, 2, 4):
        word = (word[:-step] << np.uint64(8 * step)) | word[step:]
    place, covered = np.flatnonzero(ahead <= width - 8), 8
    rank = np.zeros(len(data) + width, np.int64)
    rank[place] = np.unique(word[place], return_inverse=True)[1]
    while covered < width:
        step = min(covered, width - covered)
        place = place[ahead[place] <= width - covered - step]
        rank[place] = np.unique((rank[place] << 32) | rank[place + step], return_inverse=True)[1]
        covered += step
    return rank[place]


def repeated_in(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Whether each start of the strings, one after another, has a neighbour with equal ``width`` bytes in suffix order."""
    rank = prefix_ranks(data, at, width)
    order = np.argsort(rank, kind="stable")
    same = rank[order[1:]] == rank[order[:-1]]
    hit = np.empty(len(rank), bool)
    hit[order] = np.r_[same, False] | np.r_[False, same]
    return hit


def whole_buckets(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows of whole buckets, of about ``least`` bytes or more together, from rows in order of ``name``."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= least:
            name, last = batch.column(0).to_numpy(), held[-1].column(0)[-1].as_py()
            cut = int(np.searchsorted(name, last, "right"))
            if cut < batch.num_rows:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.column(3).nbytes
    if held:
        yield pa.Table.from_batches(held)


def repeated_starts(units: DataFrame, width: int) -> DataFrame:
    """key and the runs [froms, tos) of starts that repeat, of the stretches that aren't covered."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches, SORTED_BYTES):
            strings = table.column("bytes").combine_chunks()
            _, offsets, data = strings.buffers()
            at = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
            data, at = np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
            starts = np.diff(at) - width + 1
            covered = table.column("covered").to_numpy()
            hit = repeated_in(data, at, width) & ~np.repeat(covered, starts)
            end = np.cumsum(starts)
            fresh = np.zeros(len(hit) + 1, bool)
            fresh[0] = fresh[end] = True
            up = np.flatnonzero(hit & (fresh[:-1] | ~np.r_[False, hit[:-1]]))
            down = np.flatnonzero(hit & (fresh[1:] | ~np.r_[hit[1:], False])) + 1
            of = np.searchsorted(end, up, "right")
            shift = table.column("begin").to_numpy()[of] - (end - starts)[of]
            yield pa.RecordBatch.from_arrays([pa.array(table.column("key").to_numpy()[of]), pa.array(up + shift), pa.array(down + shift)],
                                             names=["key", "first", "stop"])

    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = units.select("name", "key", "begin", "bytes", "covered").repartition(tasks, "name").sortWithinPartitions("name")
    return ordered.mapInArrow(sort, "key long, first long, stop long")


def counted_starts(units: DataFrame, width: int) -> DataFrame:
    """``repeated_starts`` by counts of the digests of all strings, for buckets of any size."""
    j = F.explode(F.expr(f"sequence(0, length(bytes) - {width})"))
    strings = units.select("key", "begin", "covered", "bytes", j.alias("j")).select(
        "key", "covered", (F.col("begin") + F.col("j")).alias("first"), F.md5(F.expr(f"substring(bytes, j + 1, {width})")).alias("digest"))
    twice = strings.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    return strings.where("not covered").join(twice, "digest", "left_semi").select("key", "first", (F.col("first") + 1).alias("stop"))


def repeats_removed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.col(id_col).cast("long")
    base = docs.select(doc.alias("doc_id"), F.xxhash64(F.coalesce(doc.cast("string"), F.lit("none")), text).alias("key"), text.alias("__text"))
    marks = written(marked(with_short_batches(base), width))
    names = marks.groupBy("name").agg(F.count("*").alias("n"), F.min("stretch").alias("low"), F.max("stretch").alias("high"))
    shared = written(names.where("n > 1").select("name", (F.col("low") != F.col("high")).alias("differs")))
    hits = written(marks.join(shared, "name"))
    # of stretches that repeat as a whole, one is compared with the others of its bucket
    kinds = written(hits.where("differs").groupBy("name", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("key", "slot")).alias("one")))
    crowds = kinds.groupBy("name").agg((F.count("*") > crowd).alias("crowded"))
    open_ = kinds.join(crowds, "name").select("one.key", F.struct("one.slot", (F.col("n") > 1).alias("covered"), "crowded").alias("open"))
    open_ = open_.groupBy("key").agg(F.collect_list("open").alias("open"))
    whole = hits.where("not differs").select("key", "slot").union(
        hits.where("differs").join(kinds.where("n > 1"), ["name", "stretch"], "left_semi").select("key", "slot"))
    whole = whole.groupBy("key").agg(F.collect_set("slot").alias("slots"))
    units = written(opened(base.join(open_, "key").dropDuplicates(["key"]), width))
    starts = repeated_starts(units.where("not crowded"), width)
    if not crowds.where("crowded").isEmpty():
        starts = starts.union(counted_starts(units.where("crowded"), width))
    starts = starts.groupBy("key").agg(F.collect_list("first").alias("firsts"), F.collect_list("stop").alias("stops"))
    plan = written(starts.join(whole, "key", "full_outer").select("key", "slots", "firsts", "stops"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "__text"):
                mark = np.zeros(len(data) + 1, np.int64)
                listed = lambda c: (np.repeat(np.arange(part.num_rows), np.diff(c.offsets.to_numpy())), c.flatten().to_numpy())
                slots, firsts, stops = part.columns[2:5]
                of, slot = listed(slots)
                if len(of):
                    _, lo, hi, row = stretches(Prefixes(byte_values(data)), at, width)
                    k = np.searchsorted(row, of) + slot
                    np.add.at(mark, lo[k], 1)
                    np.add.at(mark, hi[k] + width - 1, -1)
                of, first = listed(firsts)
                np.add.at(mark, first + at[of], 1)
                of, stop = listed(stops)
                np.add.at(mark, stop + width - 1 + at[of], -1)
                gone = np.cumsum(mark)[:-1] > 0
                removed, spans, sha = [], [], []
                for r in range(part.num_rows):
                    cut = gone[at[r] : at[r + 1]]
                    removed.append(int(cut.sum()))
                    spans.append(int((cut[1:] & ~cut[:-1]).sum() + cut[:1].sum()))
                    sha.append(hashlib.sha256(data[at[r] : at[r + 1]][~cut].tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return (base.join(plan, "key", "left").select("doc_id", "__text", "slots", "firsts", "stops")
            .mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


@named("op2_suffix_array_dedup")
def op2_suffix_array_dedup(spark, sf_dir):
    return repeats_removed(table(spark, sf_dir, "documents"))
