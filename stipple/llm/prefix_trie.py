"""Shared beginnings of conversations as a trie, one balanced-parentheses sequence per shard.

A conversation is a path of turns, each a 128-bit digest of (role, text) with the UTF-8 length of the text; texts are never moved after
that. Paths are sorted by (turns, conv_id) over shards of about ``TURNS_A_SHARD`` turns. A shard writes its distinct prefixes as
a sequence of parentheses in preorder: ``findclose`` through a tree of block minima of the excess delimits a subtree, the rank of
leaf pairs ``()`` counts its leaves, and cumulative arrays over preorder give members and savings.

A prefix can only lie in several shards if it is one of the first or the last path of each of them: its spines. Spine nodes
give partial counts under the hash of their turns, and groupings and joins over the spines alone (two paths a shard)
merge them; subtree sums run along each path from its end, every distinct node counted on the first path that holds it.
Copies of a conversation are split over shards by conv_id, so a first turn, a conversation or a group of copies
that a third of all rows share is spread. The digest over the ids of such a group is read in order
by one task in pieces, since SHA-256 allows nothing else; ids alone pass there, never more than a piece is held.

Turns are ordered by (turn, role, digest), null turns first; null roles and texts are empty. Rows without a conversation id
are dropped. A repeated row is a turn of its own. Remainders of negative ids are those of SQL (towards zero). Turnless conversations are
members of the root alone, whose parent is null. An empty table gives no node. Very long texts only pass their digest;
the digests of one conversation (24 bytes a turn) must fit in a task. Other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipple.llm.registry import named, table
from stipple.llm.shared import written

TURNS_A_SHARD = 100_000
FAMILY = 5  # Fixed value: conversations c - c % 5 .. lend their first turns.
HEADS = 9  # Fixed value: crc32 of the id modulo 9 turns are lent.
IDS_A_PIECE = 4096
BLOCK = 64
WHOLE, PATH, ENDS = 0, 1, 2
SHARD_ROWS = ("part int, kind int, side int, depth long, node binary, up binary, bytes long, conv_id long, parent_conv_id long, "
              "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string")
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """A balanced sequence with the excess after each position and the minima of its blocks, level over level."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.opens = np.flatnonzero(bits)
        self.ones = np.cumsum(bits, dtype=np.int64)
        excess = np.cumsum(np.where(bits, 1, -1))
        room = -(-len(bits) // BLOCK) * BLOCK
        self.excess = np.full(room, 1 << 40, np.int64)
        self.excess[: len(bits)] = excess
        self.levels = [self.excess.reshape(-1, BLOCK).min(axis=1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            if len(low) % 2:
                low = self.levels[-1] = np.append(low, 1 << 40)
            self.levels.append(low.reshape(-1, 2).min(axis=1))
        leaf = np.zeros(len(bits), np.int64)
        leaf[:-1] = bits[:-1] & ~bits[1:]
        self.leaf_pairs = np.cumsum(leaf)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The parenthesis that closes each open one: the first later place with an excess below that of the opening."""
        out = np.empty(len(at), np.int64)
        for first in range(0, len(at), 1 << 14):
            out[first : first + (1 << 14)] = self._close(at[first : first + (1 << 14)])
        return out

    def _close(self, at: np.ndarray) -> np.ndarray:
        goal, block = self.excess[at] - 1, at // BLOCK
        inside = (self.excess.reshape(-1, BLOCK)[block] <= goal[:, None]) & (np.arange(BLOCK) > (at % BLOCK)[:, None])
        found = inside.any(axis=1)
        out = block * BLOCK + inside.argmax(axis=1)
        far = np.flatnonzero(~found)
        node, want, level = block[far], goal[far], 0
        seek, height = np.ones(len(far), bool), np.zeros(len(far), np.int64)
        while seek.any():  # up until a block to the right reaches the goal
            right = (node % 2 == 0) & (node + 1 < len(self.levels[level]))
            hit = seek & right & (self.levels[level][np.minimum(node + 1, len(self.levels[level]) - 1)] <= want)
            node = np.where(hit, node + 1, node)
            height = np.where(hit, level, height)
            seek &= ~hit
            node = np.where(seek, node // 2, node)
            level += 1
        for level in range(len(self.levels) - 1, 0, -1):  # and down to its first block that does
            down = height == level
            left = np.minimum(2 * node, len(self.levels[level - 1]) - 1)
            node = np.where(down, np.where(self.levels[level - 1][left] <= want, 2 * node, 2 * node + 1), node)
            height = np.where(down, level - 1, height)
        if len(far):
            out[far] = node * BLOCK + (self.excess.reshape(-1, BLOCK)[node] <= want[:, None]).argmax(axis=1)
        return out


class Shard:
    """The trie of sorted paths: arrays over its nodes in preorder, the root first."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray, keys: np.ndarray, sizes: np.ndarray):
        self.ids, self.lens, self.keys = ids, lens, keys
        self.at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(lens, out=self.at[1:])
        shared = self._shared()
        conv = np.repeat(np.arange(len(ids)), lens)
        place = np.arange(self.at[-1]) - self.at[conv]
        new = place >= shared[conv]
        self.depth = np.concatenate([[0], place[new] + 1])
        self.bytes = np.concatenate([[0], sizes[new]])
        n = len(self.depth)
        runs = np.empty(2 * len(ids) + 2, np.int64)
        runs[0:-2:2] = np.concatenate([[0], lens[:-1]]) - shared
        runs[1:-2:2] = lens - shared
        runs[-2:] = lens[-1], 0
        bits = np.repeat(np.arange(len(runs)) % 2 == 1, runs)
        self.tree = Parentheses(np.concatenate([[True], bits, [False]]))
        close = self.tree.findclose(self.tree.opens)
        self.below = self.tree.ones[close]  # preorder end of the subtree
        self.leaves = self.tree.leaf_pairs[close] - np.concatenate([[0], self.tree.leaf_pairs])[self.tree.opens]
        order = np.sort(self.depth * n + np.arange(n))
        above = np.searchsorted(order, (self.depth - 1) * n + np.arange(n)) - 1
        self.parent = np.where(self.depth > 0, order[above] % n, -1)
        last = np.cumsum(np.bincount(conv[new], minlength=len(ids)))  # the last node of each path
        self.ends = np.bincount(last, minlength=n)
        self.members_at = np.concatenate([[0], np.cumsum(self.ends)])
        first, end = self.members_at[:-1], self.members_at[self.below]
        self.members = end - first
        pairs = np.stack([first, end], axis=1).ravel()
        self.least = np.minimum.reduceat(np.append(ids, ids.max()), pairs)[::2]

    def _shared(self) -> np.ndarray:
        """Turns that each path has in common with the one before it."""
        conv = np.repeat(np.arange(len(self.lens)), self.lens)
        place = np.arange(self.at[-1]) - self.at[conv]
        before = np.maximum(conv - 1, 0)
        inside = (conv > 0) & (place < self.lens[before])
        other = np.where(inside, self.at[before] + place, 0)
        differs = ~inside | (self.keys != self.keys[other]).any(axis=1) if len(place) else np.zeros(0, bool)
        out = self.lens.copy()
        full = np.flatnonzero(self.lens)
        if len(full):
            out[full] = np.minimum(out[full], np.minimum.reduceat(np.where(differs, place, 1 << 40), self.at[full]))
        return out

    def cumulative(self, values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` over the subtree of every node."""
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[self.below] - sums[:-1]

    def spine(self, conv: int) -> tuple[np.ndarray, list[bytes]]:
        """Nodes of a first or last path from the root on, and the hashes of their turns."""
        if conv == 0:
            nodes = np.arange(self.lens[0] + 1)
        else:
            latest = np.zeros(self.depth.max() + 1, np.int64)
            np.maximum.at(latest, self.depth, np.arange(len(self.depth)))
            nodes = latest[: self.lens[conv] + 1]
        h = hashlib.sha256()
        hashes = [h.digest()[:16]]
        for key in self.keys[self.at[conv] : self.at[conv + 1]]:
            h.update(key.tobytes())
            hashes.append(h.copy().digest()[:16])
        return nodes, hashes

    def ids_at(self, node: int) -> np.ndarray:
        return self.ids[self.members_at[node] : self.members_at[node] + self.ends[node]]


def joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def rows_of(shard: Shard, part: int) -> Iterator[pa.Table]:
    spines = [shard.spine(0), shard.spine(len(shard.ids) - 1)]
    own = np.full(len(shard.depth), -1)
    own[spines[1][0]] = 1
    own[spines[0][0]] = 0  # a node of both is counted on the first path
    whole = own < 0
    value = np.where(whole, (shard.members - 1) * shard.bytes, 0)
    saved = shard.cumulative(value)
    leaf = shard.cumulative((whole & (shard.below == np.arange(len(whole)) + 1)).astype(np.int64))
    all_children = np.bincount(shard.parent[1:], minlength=len(whole))
    children = np.bincount(shard.parent[whole], minlength=len(whole)) if whole.any() else np.zeros(len(whole), np.int64)
    k = np.flatnonzero(whole)
    up = shard.parent[k]
    digests = [hashlib.sha256(joined(shard.ids_at(i)).encode()).hexdigest() if shard.ends[i] else NO_ENDS for i in k]
    yield table_of(part, WHOLE, len(k), side=own[up], depth=shard.depth[k], conv_id=shard.least[k],
                   parent_conv_id=pa.array(shard.least[up], pa.int64(), mask=own[up] >= 0), n_convs=shard.members[k],
                   n_children=all_children[k], n_leaves=shard.leaves[k], saved_tokens=saved[k], ends=digests)
    for side, (nodes, hashes) in enumerate(spines):
        mine = (own[nodes] == side).astype(np.int64)
        if side and len(shard.ids) == 1:
            break
        yield table_of(part, PATH, len(nodes), side=np.full(len(nodes), side), depth=shard.depth[nodes], node=hashes, up=[None, *hashes[:-1]],
                       bytes=shard.bytes[nodes], conv_id=pa.array(shard.least[nodes], pa.int64(), mask=mine == 0), n_convs=shard.members[nodes] * mine,
                       n_children=children[nodes] * mine, n_leaves=leaf[nodes] * mine, saved_tokens=saved[nodes] * mine)
        for node, name, counted in zip(nodes, hashes, mine):
            ids = shard.ids_at(node) if counted else ()
            for piece in range(0, len(ids), IDS_A_PIECE):
                yield table_of(part, ENDS, 1, depth=[piece], node=[name], ends=[joined(ids[piece : piece + IDS_A_PIECE])])


def table_of(part: int, kind: int, n: int, **columns) -> pa.Table:
    types = {"part": pa.int32(), "kind": pa.int32(), "side": pa.int32(), "node": pa.binary(), "up": pa.binary(), "ends": pa.string()}
    columns |= {"part": np.full(n, part), "kind": np.full(n, kind)}
    names = [c.split()[0] for c in SHARD_ROWS.split(", ")]
    return pa.table({c: (pa.array(v, types.get(c, pa.int64())) if not isinstance(v := columns.get(c, [None] * n), pa.Array) else v) for c in names})


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted paths of a task as one shard."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    paths = pa.Table.from_batches(got).combine_chunks()
    flat = b"".join(joined_bytes(k) for c in paths["keys"].chunks if len(k := c.flatten()))
    lens = np.concatenate([c.value_lengths().to_numpy() for c in paths["keys"].chunks]).astype(np.int64)
    sizes = np.concatenate([c.flatten().to_numpy() for c in paths["sizes"].chunks]).astype(np.int64)
    shard = Shard(paths["conv_id"].to_numpy(), lens, np.frombuffer(flat, np.uint64).reshape(-1, 2), sizes)
    for rows in rows_of(shard, TaskContext.get().partitionId()):
        yield from rows.to_batches()


def joined_bytes(values: pa.BinaryArray) -> bytes:
    """The bytes of consecutive 16-byte values."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1]
    return data[at[0] : at[-1]].to_pybytes()


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends): the hash over the joined pieces of a node, which come in order."""
    node, h = None, None
    schema = pa.schema([("node", pa.binary()), ("ends", pa.string())])
    for batch in batches:
        for name, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
            if name != node:
                if h:
                    yield pa.record_batch([[node], [h.hexdigest()]], schema=schema)
                node, h = name, hashlib.sha256()
            else:
                h.update(b",")
            h.update(piece.as_py().encode())
    if h:
        yield pa.record_batch([[node], [h.hexdigest()]], schema=schema)


def turn_key(role: Column, text: Column) -> Column:
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(said.cast("binary"), 256), 1, 32))


def rebuilt(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, keys, sizes) of every conversation after it has taken the first turns of the first of its family."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    slim = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), turn_key(role, text).alias("key"), F.octet_length(text).alias("size")).alias("t"))
    whole = written(slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).select(
        "conv_id", F.transform("ts", lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("ts")))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    own = whole.select("conv_id", "ts", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"))
    lent = whole.select(F.col("conv_id").alias("first"), F.col("ts").alias("lent"))
    rest = F.slice("ts", F.col("h") + 1, F.size("ts"))
    path = F.concat(F.slice(F.coalesce("lent", F.slice("ts", 1, 0)), F.lit(1), F.col("h")), F.when(F.size("ts") > 0, rest).otherwise(F.col("ts")))
    return own.join(lent, "first", "left").select("conv_id", path.alias("path")).select(
        "conv_id", F.col("path.key").alias("keys"), F.transform("path.size", lambda s: s.cast("long")).alias("sizes"))


def trie_nodes(paths: DataFrame, *, turns_a_shard: int = TURNS_A_SHARD) -> DataFrame:
    """One row per distinct prefix of ``paths`` (conv_id, keys, sizes), as named in SHARD_ROWS."""
    paths = written(paths)
    total = paths.agg(F.coalesce(F.sum(F.size("keys") + 1), F.lit(0))).first()[0]
    dealt = paths.repartitionByRange(1 + total // turns_a_shard, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    rows = written(dealt.mapInArrow(encoded, SHARD_ROWS))
    spine, slots = merged_spines(rows)
    whole = rows.where(F.col("kind") == WHOLE).select("part", "side", (F.col("depth") - 1).alias("up_depth"), *OUT)
    whole = whole.join(slots, ["part", "side", "up_depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up_conv"))
    return whole.select(*OUT).unionByName(spine.select(*OUT))


OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")


def merged_spines(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the shards' first and last paths over all shards, and their conv_id by (part, side, up_depth)."""
    paths = rows.where(F.col("kind") == PATH).withColumn("path", F.struct("part", "side"))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = paths.groupBy("node").agg(F.max("up").alias("up"), F.max("depth").alias("depth"), F.max("bytes").alias("bytes"),
                                      F.min("path").alias("owner"), F.min("conv_id").alias("conv_id"), *sums)
    nodes = written(nodes)
    below = nodes.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("node")).agg(F.count("*").alias("c"))
    nodes = nodes.join(below, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("c", F.lit(0)))
    own = nodes.select("node", "owner", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("value"))
    deeper = Window.partitionBy("part", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine = F.col("owner") == F.col("path")
    along = paths.select("node", "part", "side", "depth", "path").join(own, "node").select(
        "node", F.sum(F.when(mine, F.col("leaf"))).over(deeper).alias("leaf"), F.sum(F.when(mine, F.col("value"))).over(deeper).alias("value"))
    gained = along.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("value").alias("value"))
    pieces = rows.where(F.col("kind") == ENDS).repartition("node").sortWithinPartitions("node", "part", "depth").select("node", "ends")
    ends = pieces.mapInArrow(digested, "node binary, ends string")
    above = nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    spine = written(nodes.join(gained, "node").join(ends, "node", "left").join(above, "up", "left").select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        (F.col("saved_tokens") + F.coalesce("value", F.lit(0))).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends")))
    slots = paths.select("node", "part", "side", F.col("depth").alias("up_depth")).join(spine.select("node", F.col("conv_id").alias("up_conv")), "node")
    return spine, slots.drop("node")


def prefix_nodes(turns: DataFrame, *, turns_a_shard: int = TURNS_A_SHARD, **columns: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie_nodes(rebuilt(turns, **columns), turns_a_shard=turns_a_shard).withColumnRenamed("ends", "ends_sha256")


def oracle() -> str:
    """The same in SQL: each conversation's prefixes are written out and grouped."""
    byte = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = "list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))"
    return f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
names AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: {byte}), 4294967295) % {HEADS} AS h FROM names),
r AS (SELECT c.conv_id, 0 AS part, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {FAMILY} AND k <= h
  UNION ALL SELECT c.conv_id, 1, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND k > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
  sha256(string_agg(sha256(strlen(role) || ':' || role || text), '') OVER w) AS node FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, k)),
a AS (SELECT conv_id, 0 AS depth, 0 AS bytes, '' AS node FROM c UNION ALL SELECT conv_id, depth, bytes, node FROM p),
u AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM a),
n AS (SELECT node, any_value(up) AS up, depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs FROM u GROUP BY node, depth),
k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
s AS (SELECT u.node, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.bytes) AS saved_tokens
  FROM m JOIN u ON u.conv_id = m.conv_id AND u.depth <= m.depth GROUP BY 1),
e AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM
  (SELECT conv_id, arg_max(node, depth) AS node FROM a GROUP BY conv_id) GROUP BY node)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, CAST(m.n_convs AS BIGINT) AS n_convs,
  CAST(m.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
  coalesce(ends, sha256('')) AS ends_sha256
FROM m JOIN s USING (node) LEFT JOIN e USING (node) LEFT JOIN m AS o ON o.node = m.up"""


@named("op12_conversation_prefix_trie", oracle())
def op12_conversation_prefix_trie(spark, sf_dir):
    return prefix_nodes(table(spark, sf_dir, "conversations"))
