"""Best-fit packing of documents into sequences of fixed capacity by minimum bin slack.

Tokens are counted in tasks; a document longer than the capacity is cut into full pieces and one
rest. Packing itself needs only how many pieces there are of each length, at most ``capacity``
numbers however large the corpus is. For one bin a subset-sum bitset over the lengths still
available, begun with the longest, finds the fullest feasible combination; it is removed as often
as the counts allow, since the next bins would choose it again. Every pattern uses up at least one
length, so there are at most ``capacity`` patterns. Pieces then find their place by their number
among the pieces of their length: counted within each task, after the counts of the tasks before it.

Null and empty texts have only the end token. A null doc_id keeps its row: its pieces come with a
null doc_id. Repeated rows are packed once each. Other columns are never looked at. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipple.llm.registry import named, table
from stipple.llm.shared import Prefixes, byte_values, slices, with_short_batches, written

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
CACHE_UNITS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: The pre-tokenizer's own pattern, for lower-case text below U+0250, where these ranges are its letters.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9²³¹¼-¾]|[^\s{LETTER}0-9²³¹¼-¾]+")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 0 white space, 1 ASCII letter, 2 ASCII sign, 3 anything that may stand beside either.
KIND = np.full(256, 2, np.uint8)
KIND[[32, *range(9, 14)]] = 0
KIND[97:123] = 1
KIND[65:91] = 1
KIND[[39, *range(48, 58), *range(0, 9), *range(14, 32), *range(127, 256)]] = 3


class WordTokens:
    """Token ids of whole texts. Units inside words are encoded by the tokenizer once and looked up after that.

    The pre-tokenizer always separates at white space and between an ASCII letter and an ASCII sign
    other than an apostrophe, so a text's ids are the ids of those units one after the other. Units are
    known by a 64-bit hash of their lower-case bytes. Texts with bytes from 0xC9 up (U+0240 and beyond),
    control separators or marked tokens go to the tokenizer whole.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.model = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.starts, self.lens, self.used = np.empty(1 << 16, np.uint32), array("q"), array("q"), 0

    def encode_unit(self, unit: str) -> list[int]:
        out: list[int] = []
        for piece in SPLIT.findall(unit.lower()):
            mapped = piece if piece.isascii() and piece.isprintable() else "".join([BYTE_CHARS[b] for b in piece.encode()])
            out += [t.id for t in self.model.tokenize(mapped)]
        return out

    def entries(self, hashes: np.ndarray, spell) -> np.ndarray:
        """Entry numbers of the distinct ``hashes``; ``spell(i)`` gives the i-th unit's text."""
        if len(self.known) + len(hashes) > CACHE_UNITS:
            self.forget()
        known = self.known
        found = list(map(known.get, hashes.tolist()))
        if None in found:
            for i, entry in enumerate(found):
                if entry is None:
                    ids = self.encode_unit(spell(i))
                    if self.used + len(ids) > len(self.flat):
                        self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), len(ids)), np.uint32)])
                    self.flat[self.used : self.used + len(ids)] = ids
                    self.starts.append(self.used)
                    self.lens.append(len(ids))
                    self.used += len(ids)
                    found[i] = known[int(hashes[i])] = len(self.lens) - 1
        return np.array(found, np.int64)

    def ids(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other and the n + 1 offsets of the rows."""
        n = len(at) - 1
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
        odd = (data >= 0xC9) | ((data >= 0x1C) & (data <= 0x1F))
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        whole = np.add.reduceat(np.append(odd, False), np.minimum(at[:-1], len(data)), dtype=np.int64) > 0
        whole &= at[1:] > at[:-1]
        data = LOWER[data]
        kind = KIND[data]
        start = np.empty(len(data), bool)
        start[0] = kind[0] > 0
        start[1:] = (kind[1:] > 0) & ((kind[:-1] == 0) | (kind[1:] + kind[:-1] == 3) & (kind[1:] != 0) & (kind[:-1] != 0)
                                      & (kind[1:] != 3) & (kind[:-1] != 3))
        firsts = at[:-1][at[:-1] < len(data)]
        start[firsts] |= kind[firsts] > 0
        starts = np.flatnonzero(start)
        stop = np.zeros(len(data) + 1, bool)
        stop[starts] = True
        stop[1:-1] |= (kind[:-1] > 0) & (kind[1:] == 0)
        stop[at] = True
        edges = np.flatnonzero(stop)
        ends = edges[np.minimum(np.searchsorted(edges, starts, "right"), len(edges) - 1)]
        hashes = Prefixes(byte_values(data)).part(starts, ends)
        rows = np.searchsorted(starts, at)
        plain = np.repeat(~whole, np.diff(rows))
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if whole.any():
            used = np.unique(back[plain]) if plain.any() else np.empty(0, np.int64)
            entry = np.zeros(len(distinct), np.int64)
        else:
            used, entry = np.arange(len(distinct)), np.zeros(len(distinct), np.int64)
        at_of = first[used]
        entry[used] = self.entries(distinct[used], lambda i: data[starts[at_of[i]] : ends[at_of[i]]].tobytes().decode())
        own = entry[back]
        lens, begin = np.array(self.lens, np.int64), np.array(self.starts, np.int64)
        if not len(lens):
            lens = begin = np.zeros(1, np.int64)
        count = np.where(plain, lens[own], 0)
        offset = np.r_[0, np.cumsum(count)]
        flat = self.flat[np.arange(offset[-1]) - np.repeat(offset[:-1] - begin[own], count)]
        out_at = offset[rows]
        if not whole.any():
            return flat, out_at
        parts = []
        for r in range(n):
            if whole[r]:
                text = self.raw[at[r] : at[r + 1]].tobytes().decode()
                parts.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
            else:
                parts.append(flat[out_at[r] : out_at[r + 1]])
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]

    def of(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.raw = data
        return self.ids(data, at)


_TOKENS: dict[str, WordTokens] = {}


def worker_tokens(vocabulary: str) -> WordTokens:
    """One lookup for all tasks of a Python worker."""
    if vocabulary not in _TOKENS:
        _TOKENS[vocabulary] = WordTokens(vocabulary)
    return _TOKENS[vocabulary]


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


BYTE_CHARS = byte_chars()


def pieces_of(docs: DataFrame, *, id_col: str, text_col: str, capacity: int, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_tokens(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for part, data, at in slices(batch, batch.schema.names[1]):
                ids, rows = tokens.of(data, at)
                for row, doc in enumerate(part.column(0).to_pylist()):
                    seq = np.append(ids[rows[row] : rows[row + 1]], np.uint32(end_id)).astype("<u4", copy=False)
                    for k, start in enumerate(range(0, len(seq), capacity)):
                        cut_ = seq[start : start + capacity]
                        out.append((doc, k, start, len(cut_), zlib.crc32(cut_)))
            cols = list(zip(*out)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return with_short_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, PIECES)


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The fullest combination of available lengths that holds the longest one: (length, times)."""
    lengths = sorted(counts, reverse=True)
    room = capacity - lengths[0]
    mask = (1 << (room + 1)) - 1
    left = dict(counts)
    left[lengths[0]] -= 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        times, taken = min(left[length], room // length), 1
        while times > 0:
            now = min(taken, times)
            steps.append((length, now, reach))
            reach |= (reach << (length * now)) & mask
            times, taken = times - now, taken * 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {lengths[0]: 1}
    for length, now, before in reversed(steps):
        if not before >> total & 1:
            total -= length * now
            used[length] = used.get(length, 0) + now
    return sorted(used.items(), reverse=True)


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations in the order they are packed, each with the number of bins that take it."""
    counts = {k: v for k, v in counts.items() if v > 0}
    plan = []
    while counts:
        used = fullest(counts, capacity)
        repeat = min(counts[length] // times for length, times in used)
        plan.append((used, repeat))
        for length, times in used:
            counts[length] -= times * repeat
            if not counts[length]:
                del counts[length]
    return plan


def places(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """For each length rows of (first number, first bin, pieces a bin, offset in the bin), by first number."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    first = 0
    for used, repeat in plan:
        offset = 0
        for length, times in used:
            rows.setdefault(length, []).append((seen.get(length, 0), first, times, offset))
            seen[length] = seen.get(length, 0) + times * repeat
            offset += length * times
        first += repeat
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = pieces_of(docs, id_col=id_col, text_col=text_col, capacity=capacity, vocabulary=vocabulary, end_id=end_id)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            firsts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else []
            within = np.empty(len(length), np.int64)
            if len(length):
                runs = np.diff(np.r_[firsts, len(sorted_)])
                within[order] = np.arange(len(sorted_)) - np.repeat(firsts, runs) + seen[sorted_]
                seen[sorted_[firsts]] += runs
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(within)],
                                             names=[*batch.schema.names, "__in_task"])

    marked = pieces.mapInArrow(number, PIECES + ", __in_task long").withColumn("__task", F.spark_partition_id())
    marked = written(marked)
    per_task = marked.groupBy("length", "__task").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = written(per_task.withColumn("__skip", F.coalesce(F.sum("__n").over(before), F.lit(0))))
    counts = {r[0]: r[1] for r in per_task.groupBy("length").agg(F.sum("__n")).collect()}  # capacity rows at most
    table_of = docs.sparkSession.sparkContext.broadcast(places(patterns(counts, capacity)))  # capacity patterns at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = table_of.value
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            number_ = batch.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for one in np.unique(length):
                pick = np.flatnonzero(length == one)
                rows = at[int(one)]
                row = rows[np.searchsorted(rows[:, 0], number_[pick], "right") - 1]
                k = number_[pick] - row[:, 0]
                sequence[pick] = row[:, 1] + k // row[:, 2]
                offset[pick] = row[:, 3] + k % row[:, 2] * one
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                             names=[*batch.schema.names[:5], "sequence_id", "offset"])

    found = marked.join(per_task.drop("__n"), ["length", "__task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("__skip") + F.col("__in_task")).alias("__number"))
    return found.mapInArrow(place, PIECES + ", sequence_id long, offset long")


@named("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
