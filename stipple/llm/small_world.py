"""Near duplicates among embeddings by hierarchical navigable small-world graphs, one per shard.

Distinct vectors are dealt to shards by a hash. A shard links its vectors into a layered graph; a vector within half of
the threshold's angle of one already there joins that one's ball instead, so any two of a ball are linked and a
crowd of near copies is one node of the graph. Every vector then asks the graph of every other shard (one direction for each two
shards, so that a link counts for both its ends) and its own for the balls that may hold a link. Vectors of those balls
are compared in double precision. A shard's beam is doubled until an audit passes: probes at the least similarity that a
search has to reach must find their sources in ``RECALL`` of the cases, else the beam ends as wide as the graph. A search whose
beam is full of possible links is repeated with a wider one. Links are counted and joined to forests
inside the tasks; no pair leaves a task. Components are the union of the forests.

Copies of a vector are one vector with a weight. A shard has about ``SHARD_VALUES`` numbers, a block of questions as many; with more
vectors there are more shards, and a graph is sent to each block of questions. Questions to all shards move every vector
once for each second shard, which is the method's cost.

Vectors that are null, empty, zero or hold null, NaN or infinite entries link with nothing. Vectors of different lengths have
no cosine and never link. Null ids count as rows of their own and are the smallest id only where all are null. Repeated rows and
repeated ids are separate vectors. An empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.llm.registry import named, table
from stipple.llm.shared import components, written

SIMILARITY = 0.95
SHARDS = 8
SHARD_VALUES = 1 << 24
DEGREE = 16
BUILD_BEAM = 48
FIRST_BEAM = 16
RECALL = 0.99
PROBES = 200
ROUND = 512  # vectors that search in step
GRAPH = ("dim int, shard int, slot int, key string, v array<double>, copies long, ball int, angle double, links array<int>, "
         "counts array<int>, beam int, audit double, n_links long, root string")


class SmallWorld:
    """A layered graph over rows of ``x`` (unit vectors); ``ball[i]`` is the node that stands for row i, -1 before it is there."""

    def __init__(self, x: np.ndarray, seed: int = 11):
        self.x, self.x32 = x, x.astype(np.float32)
        n = len(x)
        self.ball, self.angle = np.full(n, -1, np.int32), np.zeros(n)
        draws = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(1 - draws) / np.log(DEGREE)).astype(np.int64), 6)
        self.links = [np.full((n, DEGREE * (1 if k else 2)), -1, np.int32) for k in range(1 + (int(self.level.max()) if n else 0))]
        self.entry, self.top = -1, -1

    def nodes(self) -> np.ndarray:
        return np.flatnonzero(self.ball == np.arange(len(self.ball)))

    def beam(self, layer: int, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``width`` nodes of a layer for each row of ``q``, all rows searching in step: (nodes, similarities), falling, -1 where none."""
        m, n = len(q), len(self.x)
        ids, sims = np.full((m, width), -1, np.int32), np.full((m, width), -np.inf, np.float32)
        done = np.ones((m, width), bool)
        seen = np.zeros((m, n + 1), bool)
        live = np.arange(m)
        new = start
        while len(live):
            new = np.where(new >= 0, new, n)
            fresh = ~np.take_along_axis(seen[live], new, axis=1) & (new < n)
            seen[live[:, None], new] = True
            close = np.einsum("mkd,md->mk", self.x32[np.where(fresh, new, 0)], q[live])
            all_ids = np.concatenate([ids[live], np.where(fresh, new, -1).astype(np.int32)], axis=1)
            all_sims = np.concatenate([sims[live], np.where(fresh, close, -np.inf).astype(np.float32)], axis=1)
            all_done = np.concatenate([done[live], ~fresh], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[live], sims[live] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1)
            done[live] = np.take_along_axis(all_done, order, 1)
            live = live[~done[live].all(axis=1)]
            at = (~done[live]).argmax(axis=1)
            done[live, at] = True
            new = self.links[layer][ids[live, at]].astype(np.int64)
        return ids, sims

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        if self.entry < 0:
            return np.full((len(q), 1), -1, np.int32), np.full((len(q), 1), -np.inf, np.float32)
        start = np.full((len(q), 1), self.entry, np.int64)
        for layer in range(self.top, 0, -1):
            start = self.beam(layer, q, start, 1)[0].astype(np.int64)
        return self.beam(0, q, start, width)

    def chosen(self, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Of candidates in falling order those that are nearer to the row than to one chosen before, then the nearest others: m a row."""
        kept = np.zeros(ids.shape, bool)
        for a in range(0, len(ids), 64):
            part = slice(a, a + 64)
            x = self.x32[np.maximum(ids[part], 0)]
            among = np.einsum("qcd,qed->qce", x, x, optimize=True)
            for c in range(ids.shape[1]):
                crowded = ((among[:, c] > sims[part, c, None]) & kept[part]).any(axis=1)
                kept[part, c] = (ids[part, c] >= 0) & ~crowded & (kept[part].sum(axis=1) < m)
        order = np.argsort(np.where(kept, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :m]
        out = np.take_along_axis(ids, order, 1)
        return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1) if out.shape[1] < m else out

    def connect(self, layer: int, rows: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        links = self.links[layer]
        links[rows] = self.chosen(ids, sims, links.shape[1])
        source = np.repeat(rows, links.shape[1])
        target = links[rows].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        for a in range(0, len(heads), 256):
            h, f, c = heads[a : a + 256], first[a : a + 256], count[a : a + 256]
            more = np.full((len(h), c.max()), -1, np.int32)
            where = np.arange(c.max()) < c[:, None]
            more[where] = source[np.repeat(f, c) + np.concatenate([np.arange(k) for k in c])]
            more = np.where((more[:, :, None] == links[h][:, None, :]).any(axis=2), -1, more)
            pool = np.concatenate([links[h], more], axis=1)
            near = np.where(pool >= 0, np.einsum("hkd,hd->hk", self.x32[np.maximum(pool, 0)], self.x32[h]), -np.inf)
            order = np.argsort(-near, axis=1, kind="stable")
            links[h] = self.chosen(np.take_along_axis(pool, order, 1), np.take_along_axis(near, order, 1), links.shape[1])

    def add(self, rows: np.ndarray, ball: float) -> None:
        """Rows that are within ``ball`` of a node join it; the others become nodes, linked on all layers up to their level."""
        q = self.x32[rows]
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if self.entry >= 0:
            start = np.full((len(rows), 1), self.entry, np.int64)
            for layer in range(self.top, -1, -1):
                deep = self.level[rows] >= layer
                ids, sims = np.full((len(rows), BUILD_BEAM), -1, np.int32), np.full((len(rows), BUILD_BEAM), -np.inf, np.float32)
                if deep.any():
                    ids[deep], sims[deep] = self.beam(layer, q[deep], start[deep], BUILD_BEAM)
                if not deep.all():
                    ids[~deep, :1], sims[~deep, :1] = self.beam(layer, q[~deep], start[~deep], 1)
                found[layer], start = (ids, sims), ids[:, :4].astype(np.int64)
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        best = found[0][0][:, 0] if found else np.full(len(rows), -1)
        exact = np.einsum("md,md->m", self.x[rows], self.x[np.maximum(best, 0)])
        joins = (best >= 0) & (exact >= ball)
        self._join(rows[joins], best[joins], exact[joins])
        for i in np.flatnonzero(~joins):  # those of this round that are near to each other
            near = np.flatnonzero((among[i, :i] >= ball - 1e-5) & (self.ball[rows[:i]] == rows[:i]))
            exact = self.x[rows[near]] @ self.x[rows[i]]
            if len(near) and exact.max() >= ball:
                self._join(rows[i : i + 1], rows[near[exact.argmax()]], exact.max())
            else:
                self.ball[rows[i]] = rows[i]
        own = np.flatnonzero(self.ball[rows] == rows)
        for layer in range(int(self.level[rows[own]].max()) if len(own) else -1, -1, -1):
            deep = own[self.level[rows[own]] >= layer]
            sims, k = among[np.ix_(deep, deep)], min(len(deep) - 1, BUILD_BEAM)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            ids, sims = rows[deep][order].astype(np.int32), np.take_along_axis(sims, order, 1)
            if layer in found:
                ids, sims = np.concatenate([found[layer][0][deep], ids], 1), np.concatenate([found[layer][1][deep], sims], 1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            if ids.shape[1]:
                self.connect(layer, rows[deep], np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1))
        if len(own) and (high := rows[own[self.level[rows[own]].argmax()]]) >= 0 and self.level[high] > self.top:
            self.entry, self.top = int(high), int(self.level[high])

    def _join(self, rows: np.ndarray, node: np.ndarray, sims: np.ndarray) -> None:
        self.ball[rows], self.angle[rows] = node, np.arccos(np.clip(sims, -1, 1))

    def reach(self, similarity: float) -> float:
        """Similarity down to which a search must find nodes: the threshold's angle plus the widest ball's."""
        return float(np.cos(min(np.pi, np.arccos(similarity) + self.angle.max(initial=0.0) + 1e-5)))

    def audited(self, least: float) -> tuple[int, float]:
        """(beam, recall): the first beam under which probes at the similarity ``least`` find their source."""
        nodes = self.nodes()
        sources = nodes[:: max(1, len(nodes) // PROBES)][:PROBES]
        turn = np.random.default_rng(5).normal(size=(len(sources), self.x.shape[1]))
        turn -= np.einsum("md,md->m", turn, self.x[sources])[:, None] * self.x[sources]
        turn /= np.maximum(np.linalg.norm(turn, axis=1), 1e-12)[:, None]
        probes = (least * self.x[sources] + np.sqrt(max(0.0, 1 - least**2)) * turn).astype(np.float32)
        width = FIRST_BEAM
        while True:
            hit = (self.search(probes, width)[0] == sources[:, None]).any(axis=1)
            if hit.mean() >= RECALL or width >= len(nodes):
                return width, float(hit.mean())
            width *= 2


def built(x: np.ndarray, similarity: float) -> SmallWorld:
    graph = SmallWorld(x)
    ball = float(np.cos(np.arccos(similarity) / 2)) + 1e-9
    at = 0
    while at < len(x):
        step = min(ROUND, max(32, at))
        graph.add(np.arange(at, min(at + step, len(x))), ball)
        at += step
    return graph


class Forest:
    """Roots over numbered items, the smallest item of each tree."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            split = ra != rb
            if not split.any():
                return
            np.minimum.at(self.root, np.maximum(ra, rb)[split], np.minimum(ra, rb)[split])
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def linked(graph: SmallWorld, copies: np.ndarray, q: np.ndarray, q_copies: np.ndarray, beam: int, similarity: float, own: bool):
    """Links of the rows ``q`` with the graph's vectors: (count of each q, count of each vector, q's and vectors' joined places).

    With ``own`` the rows are the graph's own; each is compared with the vectors before it.
    """
    n_q, n_x = np.zeros(len(q), np.int64), np.zeros(len(graph.x), np.int64)
    a, b = [], []
    least, nodes = graph.reach(similarity), len(graph.nodes())
    order = np.argsort(graph.ball, kind="stable")
    starts = np.searchsorted(graph.ball[order], np.arange(len(graph.x) + 1))
    widest = np.zeros(len(graph.x))
    np.maximum.at(widest, graph.ball, graph.angle)
    cuts = np.cos(np.minimum(np.pi, np.arccos(similarity) + widest + 1e-5))
    hits_q, hits_n = [], []
    step = max(1, min(ROUND, (1 << 25) // (len(graph.x) + 1)))
    for first in range(0, len(q), step):
        rows, width = np.arange(first, min(first + step, len(q))), beam
        while len(rows):
            ids, sims = graph.search(q[rows].astype(np.float32), width)
            more = (sims[:, -1] >= least - 1e-5) & (width < nodes)
            near = (ids >= 0) & (sims >= cuts[np.maximum(ids, 0)] - 1e-5) & ~more[:, None]
            i, j = np.nonzero(near)
            hits_q.append(rows[i])
            hits_n.append(ids[i, j])
            rows, width = rows[more], 2 * width
    at_q, at_n = np.concatenate(hits_q or [np.empty(0, int)]), np.concatenate(hits_n or [np.empty(0, int)])
    by = np.argsort(at_n, kind="stable")
    at_q, at_n = at_q[by], at_n[by]
    heads, begin = np.unique(at_n, return_index=True)
    for node, rows in zip(heads, np.split(at_q, begin[1:])):
        members = order[starts[node] : starts[node + 1]]
        if own and len(rows) == 1 and len(members) == 1 and rows[0] == members[0]:
            continue
        for f in range(0, len(rows), ROUND):
            some = rows[f : f + ROUND]
            for g in range(0, len(members), 1 << 13):
                part = members[g : g + (1 << 13)]
                near = q[some] @ graph.x[part].T >= similarity
                if own:
                    near &= part[None, :] < some[:, None]
                n_q[some] += near @ copies[part]
                n_x[part] += near.T @ q_copies[some]
                met = some[near.any(axis=1)]
                a.append(met)
                b.append(np.full(len(met), node))
    return n_q, n_x, np.concatenate(a or [np.empty(0, int)]).astype(int), np.concatenate(b or [np.empty(0, int)]).astype(int)


def unit(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks]).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1)[:, None]  # squares of very large and very small entries stay in range
    return x / np.linalg.norm(x, axis=1)[:, None]


def graph_of(similarity: float):
    """A shard's vectors with their graph, the links within the shard and a root for each vector."""

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        dim, n = rows["dim"][0].as_py(), rows.num_rows
        x = unit(rows["v"], dim)
        copies = rows["copies"].to_numpy()
        graph = built(x, similarity)
        beam, audit = graph.audited(graph.reach(similarity))
        n_q, n_x, a, b = linked(graph, copies, x, copies, beam, similarity, True)
        forest = Forest(n)
        forest.join(np.arange(n), graph.ball)
        forest.join(a, b)
        keys = np.array(rows["key"].to_pylist(), object)
        links, counts = [], []
        for i in range(n):
            lists = [k[i][k[i] >= 0] for k in graph.links[: graph.level[i] + 1]] if graph.ball[i] == i else []
            links.append(np.concatenate(lists) if lists else np.empty(0, np.int32))
            counts.append([len(k) for k in lists])
        return pa.table({
            "dim": rows["dim"], "shard": rows["shard"], "slot": pa.array(np.arange(n), pa.int32()), "key": rows["key"], "v": rows["v"], "copies": rows["copies"],
            "ball": pa.array(graph.ball, pa.int32()), "angle": graph.angle, "links": pa.array(links, pa.list_(pa.int32())),
            "counts": pa.array(counts, pa.list_(pa.int32())), "beam": pa.array(np.full(n, beam), pa.int32()), "audit": np.full(n, audit),
            "n_links": n_q + n_x + copies - 1, "root": pa.array(keys[forest.root], pa.string())})

    return build


def restored(rows: pa.Table) -> SmallWorld:
    graph = SmallWorld.__new__(SmallWorld)
    graph.x = unit(rows["v"], rows["dim"][0].as_py())
    graph.x32 = graph.x.astype(np.float32)
    graph.ball, graph.angle = rows["ball"].to_numpy().copy(), rows["angle"].to_numpy()
    counts, links = rows["counts"].to_pylist(), rows["links"].to_pylist()
    graph.top = max(map(len, counts)) - 1
    graph.links = [np.full((len(counts), DEGREE * (1 if k else 2)), -1, np.int32) for k in range(graph.top + 1)]
    graph.entry = next(i for i, c in enumerate(counts) if len(c) == graph.top + 1)
    for i, (count, row) in enumerate(zip(counts, links)):
        at = 0
        for k, c in enumerate(count):
            graph.links[k][i, :c] = row[at : at + c]
            at += c
    return graph


def asked_of(similarity: float):
    """Links of a block of other shards' vectors with a shard: (key, n_links, root) of every vector that has one."""
    schema = pa.schema([("key", pa.string()), ("n_links", pa.int64()), ("root", pa.string())])

    def ask(rows: pa.Table, questions: pa.Table) -> pa.Table:
        if not rows.num_rows or not questions.num_rows:
            return schema.empty_table()
        rows = rows.sort_by("slot")
        graph = restored(rows)
        q = unit(questions["v"], rows["dim"][0].as_py())
        n_q, n_x, a, b = linked(graph, rows["copies"].to_numpy(), q, questions["copies"].to_numpy(), rows["beam"][0].as_py(), similarity, False)
        forest = Forest(len(n_x) + len(n_q))
        forest.join(a + len(n_x), b)
        n = np.concatenate([n_x, n_q])
        keys = np.array(rows["key"].to_pylist() + questions["key"].to_pylist(), object)
        some = np.flatnonzero((n > 0) | (forest.root != np.arange(len(n))))
        return pa.table({"key": pa.array(keys[some], pa.string()), "n_links": n[some], "root": pa.array(keys[forest.root[some]], pa.string())}, schema=schema)

    return ask


def sound(v: Column) -> Column:
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(finite & (F.size(v) > 0) & F.exists(v, lambda c: c != 0), F.lit(False))


def shard_graphs(distinct: DataFrame, similarity: float = SIMILARITY, shards: int | None = None) -> DataFrame:
    """The graphs of all shards as a table, one row for each distinct vector (columns of GRAPH)."""
    values = distinct.agg(F.coalesce(F.sum(F.col("dim").cast("long")), F.lit(0))).first()[0]
    shards = shards or max(SHARDS, -(-values // SHARD_VALUES))
    dealt = distinct.select("dim", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", "v", "copies")
    return written(dealt.groupBy("dim", "shard").applyInArrow(graph_of(similarity), GRAPH))


def cross_links(graphs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, n_links, root) of links between shards, a row for each block of questions that a vector has links in."""
    count, top, values = graphs.agg(F.count("*"), F.coalesce(F.max("shard"), F.lit(0)), F.coalesce(F.sum(F.col("dim").cast("long")), F.lit(0))).first()
    blocks = 1 + values // (4 * SHARD_VALUES)
    i = F.col("shard")
    others = F.filter(F.sequence(F.lit(0), F.lit(top)), lambda j: (j != i) & (((i + j) % 2 == 0) == (i < j)))
    asked = graphs.select("dim", F.explode(others).alias("shard"), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "key", "v", "copies")
    told = graphs.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(int(blocks - 1)))).alias("block"),
                         "slot", "key", "v", "copies", "ball", "angle", "links", "counts", "beam")
    keys = ("dim", "shard", "block")
    return told.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(asked_of(similarity), "key string, n_links long, root string")


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = SIMILARITY,
                 shards: int | None = None) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"), sound(v).alias("ok"))
    name = F.concat_ws(".", F.hex(F.xxhash64(F.lit(1), "v")), F.hex(F.xxhash64(F.lit(2), "v")), F.size("v").cast("string"))
    rows = rows.withColumn("key", F.when(F.col("ok"), name))
    distinct = written(rows.where("ok").groupBy("key").agg(F.first("v").alias("v"), F.min("id").alias("least"), F.count("*").alias("copies"))
                       .withColumn("dim", F.size("v")))
    graphs = shard_graphs(distinct, similarity, shards)
    links = written(graphs.select("key", "n_links", "root").unionByName(cross_links(graphs, similarity)))
    joined = components(links.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    groups = distinct.select("key", "least").join(joined.select(F.col("node").alias("key"), "component"), "key", "left").select(
        "key", "least", F.coalesce("component", "key").alias("group"))
    lowest = groups.groupBy("group").agg(F.min("least").alias("component_id"))
    found = groups.join(lowest, "group").join(links.groupBy("key").agg(F.sum("n_links").alias("n_links")), "key").select("key", "component_id", "n_links")
    out = rows.select("id", "key").join(found, "key", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


@named("op11_embedding_small_world")
def op11_embedding_small_world(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
