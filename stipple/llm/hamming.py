"""MinHash near-duplicates by a multi-index Hamming join.

Every distinct shingle set gets 64 minima, each kept as a symbol of b = 16 bits. Two signatures
are near when at most ``max_distance`` symbols differ. The 64 symbols are split into 16 chunks of
4: by the pigeonhole principle, signatures within 31 differ by at most floor(31 / 16) = 1 symbol in
some chunk. So each signature is filed under the 4 ways to leave one symbol of each chunk out, and
near signatures always share a key. Sets with a similarity of 0.75 differ in 16 symbols on average
with a deviation of 3.5; more than 31 happens about once in 50,000 such pairs.

Equal sets are one representative from the start. Within a key, all members are compared with the
member that shares most keys with others. Keys whose members are then in several components are dealt into
blocks, and each two blocks meet in one group: no task holds a whole key. A pair of different components is looked at in
the first key it shares; 16 bits of each shingle bound the intersection from above, so few pairs that are
no links are left, and candidates are given as trees. Every candidate is confirmed on the full sets; where one is
no link, its blocks meet once more and give all candidates that are still apart. Nothing is capped.

Null texts and texts without words have no shingles and link to nothing. A null doc_id cannot be
named as a partner: such rows are kept and stand alone with a null component. Rows repeated in
doc_id are one document, whose shingles are those of its largest text. Other columns are never
looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.llm.registry import named, table
from stipple.llm.shared import (LOWER, Prefixes, Trees, byte_values, components, dealt, groups, mixed, slices, with_short_batches,
                                word_bounds, written)

WORDS = 5
SYMBOLS = 64
CHUNK = 4
MAX_DISTANCE = SYMBOLS // CHUNK * 2 - 1
BLOCK = 512
_MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.random.default_rng(8).integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """Per row the sorted 64-bit hashes of its distinct shingles; fewer words than that are one shingle."""
    data = LOWER[data]
    starts, ends, rows = word_bounds(data, at)
    h = Prefixes(byte_values(data)).part(starts, ends)
    if len(h) >= words:
        steps = np.resize(_STEPS, words)
        width = len(h) - words + 1
        rolled = np.zeros(width, np.uint64)
        for k in range(words):
            rolled += h[k : k + width] * steps[k]
        rolled = mixed(rolled)
    for r in range(len(at) - 1):
        first, last = rows[r], rows[r + 1]
        if last - first >= words:
            values = np.sort(rolled[first : last - words + 1])
            yield values[np.r_[True, values[1:] != values[:-1]]]
        elif last > first:
            short = np.array([last - first], np.uint64)
            for k in range(first, last):
                short = mixed(short * np.uint64(31) + h[k : k + 1])
            yield short
        else:
            yield np.empty(0, np.uint64)


def signature(values: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """``symbols`` minima of the set under multiplicative hashes, each cut to 16 bits."""
    least = np.full(symbols, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(values), 8192):
        np.minimum(least, (values[None, k : k + 8192] * _MULTIPLIERS[:symbols, None]).min(axis=1), out=least)
    return (mixed(least) >> np.uint64(48)).astype(np.uint16)


def set_hash(values: np.ndarray) -> tuple[int, int, int]:
    """The size of a set and 128 bits that stand for it."""
    other = mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return len(values), int(mixed(values).sum(dtype=np.uint64).astype(np.int64)), int(other.sum(dtype=np.uint64).astype(np.int64))


def signed(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_hash (two longs), sig."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, batch.schema.names[1]):
                n, a, b, sig = [], [], [], []
                for values in shingle_sets(data, at):
                    size, x, y = set_hash(values)
                    n.append(size)
                    a.append(x)
                    b.append(y)
                    sig.append(signature(values).tobytes() if len(values) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                     pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "hash_a", "hash_b", "sig"])

    schema = "doc_id long, n_shingles long, hash_a long, hash_b long, sig binary"
    return with_short_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(sign, schema)


def filed(reps: DataFrame) -> DataFrame:
    """(key, rep) for each chunk of the signature and each symbol of it left out."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = batch.column(0).to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(rep), SYMBOLS)
            keys = []
            for chunk in range(SYMBOLS // CHUNK):
                for left_out in range(CHUNK):
                    key = np.full(len(rep), chunk * CHUNK + left_out + 1, np.uint64)
                    for k in range(CHUNK):
                        if k != left_out:
                            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, chunk * CHUNK + k])
                    key = key & ~np.uint64(SYMBOLS - 1) | np.uint64(chunk * CHUNK + left_out)  # the symbol left out can be read
                    keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(rep, len(keys)))],
                                             names=["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(file, "key long, rep long")


def near_signatures(pairs: DataFrame, reps: DataFrame, max_distance: int) -> DataFrame:
    """Those of the pairs ``a`` < ``b`` whose signatures differ in at most ``max_distance`` symbols."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                y = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                keep = (x != y).sum(axis=1) <= max_distance
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa"))
    right = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(near, "a long, b long")


def of_sets(wanted: DataFrame, docs: DataFrame, one: DataFrame) -> DataFrame:
    """id, text and set hash of the documents in question; of repeated ids every text comes."""
    keyed = wanted.join(one, wanted["id"] == one["doc_id"]).select("id", "n_shingles", "hash_a", "hash_b")
    return docs.join(keyed, docs["__id"] == keyed["id"]).select("id", "__text", "n_shingles", "hash_a", "hash_b")


def confirmed(pairs: DataFrame, docs: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs with 100 * intersection >= percent * union, on the whole shingle sets.

    Sets are made again from the texts of the documents in question; they are joined to the pairs,
    never gathered, so a document with any number of partners stays spread over its pairs.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "__text"):
                values = list(shingle_sets(data, at))
                chosen = [set_hash(v) == k for v, k in zip(values, zip(*(part.column(i).to_pylist() for i in (2, 3, 4))))]
                rows = pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([v.tobytes() for v in values], pa.binary())], names=["id", "set"])
                yield rows.filter(pa.array(chosen, pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    made = written(of_sets(wanted, docs, one).mapInArrow(sets, "id long, set binary"))
    left = made.select(F.col("id").alias("a"), F.col("set").alias("x"))
    right = made.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members with the component of their representative, itself where it has no link."""
    return (members.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
            .withColumn("component", F.coalesce("component", "rep")))


def still_open(members: DataFrame, found: DataFrame) -> DataFrame:
    """key, id, n, component of the keys whose members are in more than one component."""
    placed = labelled(members.select("key", "rep", "n"), found)
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return written(placed.join(split.select("key"), "key", "left_semi").withColumnRenamed("rep", "id"))


def digests(members: DataFrame, docs: DataFrame, one: DataFrame) -> DataFrame:
    """id and 16 bits of every shingle of the members' sets, in order: they bound an intersection from above."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "__text"):
                values = list(shingle_sets(data, at))
                chosen = [set_hash(v) == k for v, k in zip(values, zip(*(part.column(i).to_pylist() for i in (2, 3, 4))))]
                short = [(v >> np.uint64(48)).astype(np.uint16).tobytes() for v in values]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(short, pa.binary())], names=["id", "digest"]).filter(
                    pa.array(chosen, pa.bool_()))

    return written(of_sets(members.select("id").distinct(), docs, one).mapInArrow(cut, "id long, digest binary").dropDuplicates(["id"]))


def first_slot(differs: np.ndarray) -> np.ndarray:
    """Per pair the symbol left out in the first key that both share; SYMBOLS where they share none."""
    per_chunk = differs.reshape(len(differs), -1, CHUNK)
    few = per_chunk.sum(axis=2) <= 1
    chunk = few.argmax(axis=1)
    slot = chunk * CHUNK + per_chunk[np.arange(len(differs)), chunk].argmax(axis=1)
    return np.where(few.any(axis=1), slot, SYMBOLS)


def counted(short: np.ndarray) -> np.ndarray:
    """The values of a sorted array, equal ones told apart by their count."""
    first = np.r_[True, short[1:] != short[:-1]]
    at = np.flatnonzero(first)
    nth = np.arange(len(short)) - np.repeat(at, np.diff(np.r_[at, len(short)]))
    return short.astype(np.int64) << 32 | nth


def met_in_blocks(blocks: DataFrame, percent: int, max_distance: int, trees: bool) -> DataFrame:
    """Candidate pairs of different components with the blocks (key, i, j) they met in.

    A pair is a candidate in the first key it shares, within ``max_distance``, where the digests
    don't rule out the similarity. With ``trees`` a pair whose members are already joined by other
    candidates of the same blocks is left out; that stands if those candidates are confirmed.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["key", "i", "j"]):
            group = group.combine_chunks()
            key, i, j = (group[c][0].as_py() for c in ("key", "i", "j"))
            slot = key & (SYMBOLS - 1)
            ids, own = group["id"].to_numpy(), group["own"].to_numpy()
            sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            short = [np.frombuffer(x, np.uint16) for x in group["digest"].to_pylist()]
            sizes = np.array([len(x) for x in short])
            joined, counts, single = Trees(group["component"].to_pylist()), None, {}
            roots, a, b = joined.roots(), [], []
            for k in range(len(ids) - 1):
                rest = np.arange(k + 1, len(ids))
                rest = rest[(roots[rest] != roots[k]) & ((own[rest] != own[k]) | (i == j))]
                rest = rest[100 * np.minimum(sizes[rest], sizes[k]) >= percent * np.maximum(sizes[rest], sizes[k])]
                if not len(rest):
                    continue
                differs = sig[rest] != sig[k]
                rest = rest[(differs.sum(axis=1) <= max_distance) & (first_slot(differs) == slot)]
                if not len(rest):
                    continue
                if counts is None:
                    counts = np.stack([np.bincount(x >> 6, minlength=1024) for x in short]).astype(np.int32)
                most = np.minimum(counts[rest], counts[k]).sum(axis=1)
                for m in rest[100 * most >= percent * (sizes[rest] + sizes[k] - most)].tolist():
                    if trees and joined.root(k) == joined.root(m):
                        continue
                    for x in (k, m):
                        if x not in single:
                            single[x] = counted(short[x])
                    both = len(np.intersect1d(single[k], single[m], assume_unique=True))
                    if 100 * both >= percent * (sizes[k] + sizes[m] - both):
                        a.append(ids[k])
                        b.append(ids[m])
                        if trees:
                            joined.join(k, m)
                if trees:
                    roots = joined.roots()
            if a:
                fixed = [pa.array(np.full(len(a), v)) for v in (key, i, j)]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *fixed], names=["a", "b", "key", "i", "j"])

    chosen = blocks.select("key", "i", "j", "own", "id", "component", "sig", "digest")
    return with_short_batches(chosen).mapInArrow(meet, "a long, b long, key long, i long, j long")


def late_links(open_: DataFrame, reps: DataFrame, docs: DataFrame, one: DataFrame, found: DataFrame, percent: int,
               max_distance: int) -> DataFrame:
    """Links that tie the components of each open key together; open_: key, id, component, n.

    Blocks give trees of candidates, which are confirmed on full sets. Blocks with a candidate that is
    no link meet once more and then give every candidate between components that are still apart.
    """
    material = digests(open_, docs, one).join(reps.select(F.col("rep").alias("id"), "sig"), "id")
    pairs = written(met_in_blocks(dealt(open_.join(material, "id"), ["key"], BLOCK), percent, max_distance, True))
    links = written(confirmed(pairs.select("a", "b"), docs, one, percent))
    failed = written(pairs.join(links, ["a", "b"], "left_anti").select("key", "i", "j").distinct())
    if failed.isEmpty():
        return links
    now = components(links.union(found.select("node", "component")))
    again = labelled(open_.join(failed.select("key").distinct(), "key", "left_semi").withColumnRenamed("id", "rep").drop("component"), now)
    again = again.withColumnRenamed("rep", "id").join(material, "id")
    blocks = dealt(again, ["key"], BLOCK, only=failed)
    more = written(met_in_blocks(blocks, percent, max_distance, False))
    return links.union(confirmed(more.select("a", "b"), docs, one, percent))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75,
                    max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signs = written(signed(docs, id_col=id_col, text_col=text_col))
    one = written(signs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.struct("n_shingles", "hash_a", "hash_b")).alias("s")).select("doc_id", "s.*"))
    with_sig = signs.select("n_shingles", "hash_a", "hash_b", "sig").where("sig is not null")
    by_set = ["n_shingles", "hash_a", "hash_b"]
    reps = written(one.where("n_shingles > 0").groupBy(*by_set).agg(F.min("doc_id").alias("rep"))
                   .join(with_sig.groupBy(*by_set).agg(F.min("sig").alias("sig")), by_set))
    texts = (docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
             .where(F.col("__id").isNotNull()))
    keys = filed(reps)
    shared_keys = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keys.join(shared_keys, "key"))
    degree = members.groupBy("rep").agg(F.sum("n").alias("degree"))
    ranked = members.join(degree, "rep").groupBy("key").agg(
        F.max(F.struct("degree", (-F.col("rep")).alias("r"))).alias("top")).select("key", (-F.col("top.r")).alias("pivot"))
    star = members.join(ranked, "key").where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    links = written(confirmed(written(near_signatures(in_order(star), reps, max_distance)), texts, one, percent))
    found = components(links)

    open_ = still_open(members, found)
    more = written(late_links(open_, reps, texts, one, found, percent, max_distance))
    if not more.isEmpty():
        found = components(more.union(found.select("node", "component")))
    final = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        *by_set, F.coalesce("component", "rep").alias("of_set"))
    named_rows = one.join(final, by_set, "left").select(
        "doc_id", "n_shingles", F.coalesce("of_set", "doc_id").alias("component_id"))
    named_rows = named_rows.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = signs.where(F.col("doc_id").isNull()).select(
        "doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return named_rows.unionByName(nameless)


@named("op7_minhash_near_dedup")
def op7_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
