"""Helpers of the operators here: text buffers as arrays, written intermediate tables, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.session import cut_lineage

BATCH_ROWS = 500
SLICE_BYTES = 500_000  # bytes of text that are laid out as arrays at once; longer texts come alone
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: ASCII capitals to small letters, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about SLICE_BYTES of text each, as (rows, bytes, offsets)."""
    data, at = buffers(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and _BASE ** -i modulo 2 ** 64 for i in 0..n; those of a usual slice are kept."""
    if _POWERS and n < len(_POWERS[0]):
        return _POWERS[0][: n + 1], _POWERS[1][: n + 1]
    size = max(n, min(2 * n, SLICE_BYTES))
    up, down = np.full(size + 1, _BASE, np.uint64), np.full(size + 1, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    made = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    if size <= SLICE_BYTES:
        _POWERS[:] = made
    return made[0][: n + 1], made[1][: n + 1]


class Prefixes:
    """Polynomial hashes of any part of one sequence in constant time, modulo 2 ** 64."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], dtype=np.uint64, out=self.sums[1:])

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mixed(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the n + 1 word offsets of the rows."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word and the n + 1 word offsets of the rows."""
    starts, ends, rows = word_bounds(data, at)
    return Prefixes(byte_values(data)).part(starts, ends), rows


def with_short_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most BATCH_ROWS rows: whole texts are long rows."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared checkpoint folder: recovery after a lost executor starts there."""
    return cut_lineage(df)


def dealt(members: DataFrame, keys: list[str], block: int, only: DataFrame | None = None) -> DataFrame:
    """The members of each key in pairs of blocks of about ``block`` rows, each pair of blocks once; ``n`` is the key's rows.

    Adds i <= j, the pair, and own, the member's block of the two. ``id`` must name the member. ``only`` lists
    the pairs of blocks wanted, with their keys.
    """
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.lit("block"), "id"), parts).cast("int")
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    spread = spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "n")
    if only is not None:
        spread = spread.join(only, [*keys, "i", "j"], "left_semi")
    return spread.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "id")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal numbers in ``keys``, across batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
        cut = np.r_[0, np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1, batch.num_rows]
        for first, end in zip(cut[:-1], cut[1:]):
            key = tuple(values[:, first])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(first, end - first))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class Trees:
    """Union-find over the labels that meet in one block."""

    def __init__(self, labels: list):
        order = {}
        self.of = [order.setdefault(x, len(order)) for x in labels]
        self.up = np.arange(len(order))

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up[self.of]

    def root(self, k: int) -> int:
        x = self.of[k]
        while self.up[x] != x:
            x = self.up[x]
        return int(x)

    def join(self, k: int, m: int) -> bool:
        """Whether the two were apart."""
        x, y = self.root(k), self.root(m)
        self.up[max(x, y)] = min(x, y)
        return x != y


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected links ``a``, ``b``; component is its smallest node.

    Each round hooks every tree below the smallest root that a link of it reaches, then pointers
    are jumped until all nodes know their root. The number of trees at least halves in a round
    for every component that is still split, and only joins and minimum aggregates are used, so
    a component of any size stays spread. An empty table gives an empty result.
    """
    both = edges.select("a", "b").where("a <> b")
    links = written(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = written(nodes.withColumn("component", F.col("node")))
    while True:
        to = labels.select(F.col("node").alias("a"), F.col("component").alias("ra"))
        fro = labels.select(F.col("node").alias("b"), F.col("component").alias("rb"))
        live = links.join(to, "a").join(fro, "b").where("ra <> rb")
        live = live.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        links = written(live)
        if links.isEmpty():
            return labels
        hooks = written(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = written(hooks.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"),
                                                                   F.col("above").isNotNull().alias("moved")))
            hooks = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        labels = written(labels.join(hooks.select(F.col("node").alias("component"), "root"), "component", "left")
                         .select("node", F.coalesce("root", "component").alias("component")))
