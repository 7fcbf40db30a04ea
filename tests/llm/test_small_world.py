"""Links and components of embeddings against all pairs, recall of the graphs, and the awkward cases of the docstring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stipple.llm import small_world

SCHEMA = "vec_id long, embedding array<double>, label int"


def crowds(seed, d=24, single=300):
    """Single vectors, crowds of near copies, chains whose ends are not linked, and exact copies."""
    rnd = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    rows = list(unit(rnd.normal(size=(single, d))))
    for size in (2, 5, 40, 150):
        middle = unit(rnd.normal(size=d))
        rows += list(unit(middle + rnd.normal(size=(size, d)) * rnd.choice([0.01, 0.03, 0.05])))
    a, b = np.linalg.qr(rnd.normal(size=(d, 2)))[0].T
    rows += [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 2.4, 0.2)]
    rows += [rows[7]] * 60 + [rows[9] * 3.0] * 2
    return [(i, [float(c) for c in v], 0) for i, v in enumerate(rnd.permutation(np.array(rows)))]


def brute(rows, similarity=0.95):
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= similarity
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(near, root[None, :], len(x)).min(axis=1))
        if (new == root).all():
            return {rows[i][0]: (int(near[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(len(x))}
        root = new


@pytest.mark.parametrize("seed,shards", [(1, 8), (2, 3)])
def test_links_equal_all_pairs(spark, seed, shards):
    rows = crowds(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in small_world.near_vectors(df, shards=shards).collect()}
    assert got == brute(rows)


def test_links_over_blocks_of_questions(spark, monkeypatch):
    rows = crowds(3, single=100)
    monkeypatch.setattr(small_world, "SHARD_VALUES", 500)  # more shards than the least, and several blocks
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in small_world.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_recall_on_larger_shards():
    """Pairs at all similarities from 0.95 up among 6,000 vectors of 32 dimensions."""
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = rnd.normal(size=x.shape)
    turn -= (turn * x).sum(axis=1)[:, None] * x
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    s = rnd.uniform(0.95, 1, len(x))[:, None]
    x = rnd.permutation(np.concatenate([x, s * x + np.sqrt(1 - s * s) * turn]))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = small_world.built(x, 0.95)
    beam, audit = graph.audited(graph.reach(0.95))
    one = np.ones(len(x), np.int64)
    n_q, n_x, *_ = small_world.linked(graph, one, x, one, beam, 0.95, True)
    want = (x @ x.T >= 0.95).sum() - len(x)
    assert audit >= 0.99 and (n_q + n_x).sum() <= want and (n_q + n_x).sum() >= 0.98 * want


def test_a_poor_graph_widens_its_beam():
    x = np.random.default_rng(7).normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = small_world.built(x, 0.95)
    for k in graph.links:
        k[:, 2:] = -1  # all but two links of each node are gone
    beam, audit = graph.audited(graph.reach(0.95))
    assert beam > small_world.FIRST_BEAM and (audit >= 0.99 or beam >= len(graph.nodes()))


def test_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]),
            (10, [1e200, 1e198]), (11, [-1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [0.0, 2.0]), (None, None), (12, [5e-324, 0.0])]
    frame = spark.createDataFrame([(i, v, 0, "x", "y", 1) for i, v in rows], SCHEMA + ", key string, root string, shard int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in small_world.near_vectors(frame).collect()), key=str)
    # rows 1, 1, 2, 10 and 12 point one way; 2 and None another
    want = [(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (10, 4, 1, False), (12, 4, 1, False), (2, 1, 2, True), (None, 1, 2, False), (None, 0, None, True)]
    want += [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11)]
    assert got == sorted(want, key=str)
    assert small_world.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_reads_every_vector(spark, tmp_path):
    rows = crowds(4, single=40)
    spark.createDataFrame(rows, SCHEMA).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert small_world.op11_embedding_small_world(spark, str(tmp_path)).count() == len(rows)
