"""Bootstrap by cells and by time blocks, with draws derived from a hash.

A pick is md5(seed, draw, unit, slot) modulo the number of choices, so a draw is the same on
every run, in every task and in any engine; nothing is sampled on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipple.functions.columns import hash_int, ratio
from stipple.operators.decompose import AREA_GUARD, MAIN_GUARD, MAIN_UM, MIN_TAIL_PAIRS, TAIL_FRACTION, TAIL_UM
from stipple.operators.skew import broadcast_if_small, numbered, small_enough
from stipple.session import cut_lineage

PERCENTILES = (0.025, 0.5, 0.975)  # Fixed value: reported percentiles of the draws.
CELLS_A_BLOCK = 500
PRODUCT_CELLS = 2000  # cells of a block in ``cell_drawn_means``: their weights in 2,000 draws are 32 MB
PICKS_A_PACK = 1 << 21  # picks that a task holds while it packs them
SLOT_TASKS = 64  # tasks that make the draws; a slot is one row until then
BIN_PARTS = 8  # tasks over which the bins of a block of cells are spread
PLAN_ROWS = 200  # rows of the block plan (100 KB each for 1,000 draws) up to which it is broadcast
MIN_VALID = 0.95  # Fixed value: share of valid draws an interval needs.


def cell_draws(cells: DataFrame, *, stratum: str, cell: str, draws: int, seed: int) -> DataFrame:
    """How often each cell is picked in each draw: (draw, stratum, cell, w), unpicked cells absent.

    Every stratum is resampled with replacement to its own size.
    """
    return cell_picks(cells, stratum=stratum, cell=cell, draws=draws, seed=seed).groupBy("draw", stratum, cell).agg(F.count("*").alias("w"))


def cell_picks(cells: DataFrame, *, stratum: str, cell: str, draws: int, seed: int) -> DataFrame:
    """The cell that each slot of each draw picks: (draw, stratum, cell)."""
    placed = numbered(cells.select(stratum, cell), [stratum], [cell], "__i")
    size = placed.groupBy(stratum).agg(F.count("*").alias("__n"))
    slots = placed.join(size, stratum).select(stratum, "__n", (F.col("__i") - 1).alias("slot"))
    picked = slot_picks(slots, stratum=stratum, draws=draws, seed=seed).select("draw", stratum, (F.col("__pick") + 1).alias("__i"))
    return picked.join(beside(placed), [stratum, "__i"]).select("draw", stratum, cell)


def slot_picks(slots: DataFrame, *, stratum: str, draws: int, seed: int) -> DataFrame:
    """The picks of ``slots`` (stratum, __n, slot) as numbers from 0: (stratum, __n, draw, __pick), one row for each slot and draw."""
    slots = cut_lineage(slots).repartition(SLOT_TASKS).select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    return slots.select(stratum, "__n", "draw", F.pmod(hash_int(F.lit(seed), F.col("draw"), F.col(stratum), F.col("slot")), "__n").alias("__pick"))


def beside(cells: DataFrame) -> DataFrame:
    """``cells`` for a join with exploded rows, whose number the planner can't see: it would take those for the smaller side and send them through the driver."""
    return F.broadcast(cells) if small_enough(cells) else cells.hint("merge")


def drawn_means(curves: DataFrame, picks: DataFrame, *, group: str, cell: str, keys: Sequence[str], value: str, draws: int) -> DataFrame:
    """Sums of every draw: (group, keys, draw, total, weight, valid), with ``weight`` over all picked rows and ``valid`` over those with a value.

    ``curves`` has (group, cell, keys, value), ``picks`` (draw, cell). The cells of a group are dealt into blocks of about ``CELLS_A_BLOCK``, for
    ``block_products``.
    """
    here = curves.select(group, cell).distinct()
    sizes = here.groupBy(group).agg((1 + F.floor(F.count("*") / CELLS_A_BLOCK)).alias("__n"))
    dealt = here.join(sizes, group).select(group, cell, F.pmod(F.xxhash64(cell), "__n").alias("__b"))
    block = Window.partitionBy(group, "__b")
    dealt = cut_lineage(dealt.select(group, cell, "__b", (F.row_number().over(block.orderBy(cell)) - 1).alias("__k"), F.count("*").over(block).alias("__w")))
    dealt = beside(dealt)
    left = picks.select(cell, "draw").join(dealt, cell).select(F.col(group).alias("__s"), "__b", (F.col("draw") * F.col("__w") + F.col("__k")).alias("__code"))
    right = curves.join(dealt, [group, cell]).select(F.col(group).alias("__s"), "__b", "__k", "__w", group, *keys, F.col(value).cast("double").alias("__v"))
    return block_products(left, right, names=[group, *keys], draws=draws)


def cell_drawn_means(
    curves: DataFrame, cells: DataFrame, *, group: str, stratum: str, cell: str, keys: Sequence[str], value: str, draws: int, seed: int,
    cells_a_block: int = PRODUCT_CELLS,
) -> DataFrame:
    """``drawn_means`` with the picks of ``cell_picks`` of ``cells`` (stratum, cell), which are never joined.

    A block is a run of cells in the numbering of their stratum, so the number that a slot picks already names its block and place.
    """
    placed = numbered(cells.select(stratum, cell), [stratum], [cell], "__i")
    size = placed.groupBy(stratum).agg(F.count("*").alias("__n"))
    placed = cut_lineage(placed.join(size, stratum).select(stratum, cell, "__n", (F.col("__i") - 1).alias("slot")))
    many = F.lit(cells_a_block)
    width = F.least("__n", many).alias("__w")
    run = lambda at: F.floor(at / many).alias("__b")
    picked = slot_picks(placed.select(stratum, "__n", "slot"), stratum=stratum, draws=draws, seed=seed)
    left = picked.select(F.col(stratum).alias("__s"), run(F.col("__pick")), (F.col("draw") * width + F.col("__pick") % many).alias("__code"))
    own = placed.select(F.col(stratum).alias("__s"), cell, run(F.col("slot")), (F.col("slot") % many).alias("__k"), width)
    right = curves.join(beside(own), cell).select("__s", "__b", "__k", "__w", group, *keys, F.col(value).cast("double").alias("__v"))
    return block_products(left, right, names=[group, *keys], draws=draws)


def block_products(left: DataFrame, right: DataFrame, *, names: Sequence[str], draws: int) -> DataFrame:
    """Sums of every draw from picks and values dealt into blocks of cells: (names, draw, total, weight, valid).

    ``left`` has (__s, __b, __code), a row for each pick, and ``right`` (__s, __b, __k, __w, names, __v). (__s, __b) is a block of ``__w`` cells, ``__k`` a
    cell's place in it and ``__code`` draw * __w + __k. Picks are packed as numbers where they are made; those of a block and its values meet in
    one task as two matrices, whose product is the block's part of every draw. The parts are added by Spark.
    """
    fields = right.select(*names).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", draw int, total double, weight double, valid double"
    sums = ["total", "weight", "valid"]

    def packed(held):
        picks = pa.Table.from_batches(held)
        strata, block = pc.unique(picks.column("__s")), picks.column("__b").to_numpy()
        most = int(block.max()) + 1
        at = np.asarray(pc.index_in(picks.column("__s"), strata)).astype(np.int64) * most + block
        order = np.argsort(at, kind="stable")
        found, first = np.unique(at[order], return_index=True)
        codes = np.split(picks.column("__code").to_numpy()[order].astype(np.int32), first[1:])
        return pa.RecordBatch.from_arrays([strata.take(pa.array(found // most)), pa.array(found % most), pa.array([c.tobytes() for c in codes], pa.binary())],
                                          names=["__s", "__b", "__p"])

    def pack(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= PICKS_A_PACK:
                yield packed(held)
                held, rows = [], 0
        if rows:
            yield packed(held)

    def product(key, picked, given):
        if not picked.num_rows or not given.num_rows:
            return pa.table([pa.array([], t) for t in (*[given.schema.field(k).type for k in names], pa.int32(), *[pa.float64()] * 3)], names=[*names, "draw", *sums])
        width = given.column("__w")[0].as_py()
        codes = np.concatenate([np.frombuffer(p, np.int32) for p in picked.column("__p").to_pylist()])
        weights = np.bincount(codes, minlength=draws * width).reshape(draws, width).astype(float)
        at = np.zeros(given.num_rows, dtype=np.int64)
        for k in names:
            values = pc.unique(given.column(k))
            at = at * (len(values) + 1) + np.asarray(pc.index_in(given.column(k), values)).astype(np.int64)
        _, first, column = np.unique(at, return_index=True, return_inverse=True)
        v = given.column("__v")
        there = np.asarray(v.is_valid()).astype(float)
        spot, shape = given.column("__k").to_numpy() * len(first) + column, (width, len(first))
        dense = lambda w: np.bincount(spot, w, shape[0] * shape[1]).reshape(shape)
        parts = [(weights @ dense(w)).ravel() for w in (np.asarray(v.fill_null(0.0)), np.ones(len(there)), there)]
        tiled = pa.array(np.tile(first, draws))
        return pa.table([*[given.column(k).take(tiled) for k in names], pa.array(np.repeat(np.arange(draws, dtype=np.int32), len(first))), *map(pa.array, parts)],
                        names=[*names, "draw", *sums])

    kind = right.schema["__s"].dataType.simpleString()
    small = left.select("__s", F.col("__b").cast("long").alias("__b"), F.col("__code").cast("int").alias("__code")).mapInArrow(pack, f"__s {kind}, __b long, __p binary")
    parts = small.groupBy("__s", "__b").cogroup(right.groupBy("__s", "__b")).applyInArrow(product, out)
    return parts.groupBy(*names, "draw").agg(*[F.sum(c).alias(c) for c in sums])


def bootstrap_mean_curves(curves: DataFrame, picks: DataFrame, *, keys: Sequence[str], cell: str, value: str) -> DataFrame:
    """Mean curve of every draw. ``curves`` has (keys, cell, bin, value)."""
    weighted = curves.join(picks.select("draw", cell, "w"), cell)
    return weighted.groupBy(*keys, "draw", "bin").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))


def cell_weights(cells: DataFrame, *, stratum: str, cell: str, draws: int, seed: int) -> DataFrame:
    """``cell_draws`` as one array per cell: (stratum, cell, w), a draw at each position, zero where the cell is not picked."""
    picks = cell_draws(cells, stratum=stratum, cell=cell, draws=draws, seed=seed)
    none = cells.select(F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), stratum, cell, F.lit(0).cast("long").alias("w"))
    each = picks.select("draw", stratum, cell, "w").unionByName(none).groupBy(stratum, cell, "draw").agg(F.sum("w").alias("w"))
    rows = each.groupBy(stratum, cell).agg(F.sort_array(F.collect_list(F.struct("draw", "w"))).alias("x"))
    return rows.select(stratum, cell, F.col("x.w").alias("w"))


def bootstrap_groups(curves: DataFrame, weights: DataFrame, *, group: str, cell: str, values: Sequence[str], cells_a_block: int = CELLS_A_BLOCK) -> DataFrame:
    """Mean of every value in every draw: (group, name, bin, means), arrays over draws; a value is missing in a draw without a cell that has it.

    ``curves`` has (group, cell, bin, values). The weights of up to about ``cells_a_block`` cells stand beside these cells' values of one
    bin, and arrays are summed over blocks, so draws never become rows and a group of any size is many blocks.
    """
    sizes = weights.groupBy(group).agg((1 + F.floor(F.count("*") / cells_a_block)).alias("__n"))
    placed = weights.join(sizes, group).select(group, cell, "w", F.pmod(F.xxhash64(cell), "__n").alias("__b"))
    placed = cut_lineage(placed)
    matrix = placed.groupBy(group, "__b").agg(F.sort_array(F.collect_list(F.struct(F.col(cell).alias("c"), "w"))).alias("ws"))
    matrix = matrix.select(group, "__b", F.col("ws.w").alias("ws"), F.explode(F.sequence(F.lit(0), F.lit(BIN_PARTS - 1))).alias("__s"))
    long = curves.select(group, cell, "bin", F.inline(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("v")) for v in values])))
    lists = long.join(placed.select(group, cell, "__b"), [group, cell]).groupBy(group, "__b", "name", "bin").agg(
        F.sort_array(F.collect_list(F.struct(F.col(cell).alias("c"), "v"))).alias("vs"))
    lists = lists.select(group, "__b", "name", "bin", F.col("vs.v").alias("vs"), F.pmod(F.xxhash64("name", "bin"), F.lit(BIN_PARTS)).cast("int").alias("__s"))
    zero = F.transform(F.get("ws", F.lit(0)), lambda w: F.lit(0.0))
    pairs = F.zip_with("vs", "ws", lambda v, w: F.struct(v.alias("v"), w.alias("w")))
    there = F.filter(pairs, lambda x: x["v"].isNotNull())
    num = F.aggregate(there, zero, lambda a, x: F.zip_with(a, x["w"], lambda p, w: p + x["v"] * w))
    den = F.aggregate(there, zero, lambda a, x: F.zip_with(a, x["w"], lambda p, w: p + w))
    parts = lists.join(matrix, [group, "__b", "__s"]).select(group, "name", "bin", F.struct(num.alias("s"), den.alias("n")).alias("p"))
    joined = parts.groupBy(group, "name", "bin").agg(F.collect_list("p").alias("ps"))
    total = lambda c: F.aggregate(F.slice("ps", 2, 1 << 30), F.get("ps", F.lit(0))[c], lambda a, x: F.zip_with(a, x[c], lambda p, q: p + q))
    return joined.select(group, "name", "bin", F.zip_with(total("s"), total("n"), lambda s, n: F.when(n > 0, s / n)).alias("means"))


def draw_percentiles(draws: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float] = PERCENTILES) -> DataFrame:
    """Percentiles over draws; a group holds one value per draw, which bounds it."""
    q = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]))
    out = draws.groupBy(*keys).agg(q.alias("q"), F.count(value).alias("draws"))
    return out.select(*keys, "draws", *[F.col("q")[i].alias(f"p{p * 100:g}".replace(".", "_")) for i, p in enumerate(probs)])


def block_picks(spark, *, last_frame: Column, stratum_frames: int, lengths: Sequence[int], draws: int, seed: int) -> DataFrame:
    """The shared plan, one row per block length and stratum: (length, stratum, blocks, picks).

    ``picks`` has for each draw as many block numbers as the stratum has blocks. Strata cover frames 0 to ``last_frame``, which may be a
    scalar subquery over the movie; a last stratum that is cut short draws among the blocks that it has.
    """
    for length in lengths:
        if length <= 1 or stratum_frames % length:
            raise ValueError("a block must divide its stratum")
    base = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in lengths])).alias("length"))
    strata = F.explode(F.sequence(F.lit(0), F.floor(last_frame / stratum_frames).cast("int"))).alias("stratum")
    left = last_frame + 1 - F.col("stratum") * stratum_frames
    base = base.select("length", strata).withColumn(
        "blocks", F.ceil(F.least(left, F.lit(stratum_frames)) / F.col("length")).cast("int"))
    pick = lambda d, k: F.pmod(hash_int(F.lit(seed), F.col("length"), d, F.col("stratum"), k), F.col("blocks")).cast("int")
    slots = F.sequence(F.lit(0), F.col("blocks") - 1)
    return base.withColumn("picks", F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda d: F.transform(slots, lambda k: pick(d, k))))


def block_plan(spark, *, last_frame: Column, stratum_frames: int, lengths: Sequence[int], draws: int, seed: int) -> DataFrame:
    """``block_picks`` as weights: (length, draw, stratum, block, w), blocks numbered over the movie."""
    picks = block_picks(spark, last_frame=last_frame, stratum_frames=stratum_frames, lengths=lengths, draws=draws, seed=seed)
    each = picks.select("length", "stratum", F.posexplode("picks").alias("draw", "p")).select("length", "draw", "stratum", F.explode("p").alias("k"))
    block = (F.col("stratum") * (F.lit(stratum_frames) / F.col("length")).cast("int") + F.col("k")).alias("block")
    return each.groupBy("length", "draw", "stratum", block).agg(F.count("*").alias("w"))


def stratum_scopes(last_frame: DataFrame, stratum_frames: int) -> DataFrame:
    """Frame ranges (scope, start, stop) of the full movie and of each stratum; ``last_frame`` has one row and column."""
    end = last_frame.select(F.col(last_frame.columns[0]).alias("__last")).where("__last is not null")
    part = lambda k: F.struct(F.concat(F.lit("s"), k).alias("scope"), (k * stratum_frames).cast("int").alias("start"),
                              F.least((k + 1) * stratum_frames, F.col("__last") + 1).cast("int").alias("stop"))
    whole = F.struct(F.lit("full").alias("scope"), F.lit(0).alias("start"), (F.col("__last") + 1).cast("int").alias("stop"))
    strata = F.transform(F.sequence(F.lit(0), F.floor(F.col("__last") / stratum_frames).cast("int")), part)
    return end.select(F.inline(F.concat(F.array(whole), strata)))


def resampling_units(spark, *, frames: int, length: int, stratum_frames: int) -> DataFrame:
    """True internal pairs of each block: source frame, target frame, block, stratum."""
    return unit_pairs(spark.range(1).select(F.lit(frames - 1)), length=length, stratum_frames=stratum_frames)


def unit_pairs(last_frame: DataFrame, *, length: int, stratum_frames: int) -> DataFrame:
    """``resampling_units`` up to a last frame that comes from the data; a block cut short has the pairs that it holds."""
    end = last_frame.select(F.col(last_frame.columns[0]).cast("int").alias("__last")).where("__last is not null")
    starts = end.select("__last", F.explode(F.sequence(F.lit(0), F.col("__last"), F.lit(length))).alias("start"))
    last = F.least(F.col("start") + length - 2, F.col("__last") - 1)
    source = F.when(last >= F.col("start"), F.sequence(F.col("start"), last)).otherwise(F.array().cast("array<int>"))
    return starts.select("start", F.explode(source).alias("source_frame")).select(
        "source_frame", (F.col("source_frame") + 1).alias("target_frame"), F.floor(F.col("start") / length).cast("int").alias("block"),
        F.floor(F.col("start") / stratum_frames).cast("int").alias("stratum"))


def block_sums(counts: DataFrame, *, length: int) -> DataFrame:
    """Per-block counts; a lag pair that leaves its block is not in any block."""
    inside = counts.where((F.col("component") != "total") | (F.col("frame") % length != length - 1))
    keys = [c for c in counts.columns if c not in ("frame", "n")]
    return inside.groupBy(*keys, F.floor(F.col("frame") / length).cast("int").alias("block")).agg(F.sum("n").alias("n"))


def drawn_counts(blocks: DataFrame, picks: DataFrame, keys: Sequence[str], *, stratum_frames: int) -> DataFrame:
    """Counts of all draws as arrays: (keys, length, scope, bin, t, b), a draw at each position.

    ``blocks`` has (keys, length, component, bin, block, n). Draws never become rows: a row holds the counts of a stratum's
    blocks, of which there are ``stratum_frames / length`` at most, and each draw sums its picks from it. The full movie is the
    sum over its strata.
    """
    per = (F.lit(stratum_frames) / F.col("length")).cast("int")
    placed = blocks.withColumns({"stratum": F.floor(F.col("block") / per).cast("int"), "k": F.pmod(F.col("block"), per).cast("int")})
    own = [*keys, "length", "stratum", "bin"]
    rows = placed.groupBy(*own, "component").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), per - 1), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)).cast("long"))
    rows = cut_lineage(rows.select(*own, "component", dense.alias("n")))  # a column inside a lambda would be built for each draw
    picks = broadcast_if_small(cut_lineage(picks), PLAN_ROWS)
    values = F.transform("picks", lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, k: a + F.get(F.col("n"), k)))
    rows = rows.join(picks, ["length", "stratum"]).select(*own, "component", values.alias("v"))
    side = lambda c: F.first(F.when(F.col("component") == c, F.col("v")), ignorenulls=True)
    both = rows.groupBy(*own).agg(side("total").alias("t"), side("background").alias("b"))
    none = F.transform(F.coalesce("t", "b"), lambda v: F.lit(0).cast("long"))
    both = cut_lineage(both.select(*own, F.coalesce("t", none).alias("t"), F.coalesce("b", none).alias("b")))
    add = lambda lists, side: F.aggregate(F.slice(lists, 2, 1 << 30), F.get(lists, F.lit(0))[side], lambda a, x: F.zip_with(a, x[side], lambda p, q: p + q))
    full = both.groupBy(*keys, "length", "bin").agg(F.collect_list(F.struct("t", "b")).alias("all"))
    full = full.select(*keys, "length", F.lit("full").alias("scope"), "bin", add(F.col("all"), "t").alias("t"), add(F.col("all"), "b").alias("b"))
    return full.unionByName(both.select(*keys, "length", F.concat(F.lit("s"), "stratum").alias("scope"), "bin", "t", "b"))


def drawn_splits(counts: DataFrame, keys: Sequence[str], *, n_bins: int, width: float) -> DataFrame:
    """The decomposition of every draw: one row per key with the bins and ``fit``, an array over draws.

    A fit is (tp, bp, beta, signed_area, main_mass, tail_mass, tail_main_ratio), NULL where the guards of ``decompose.guarded_summary``
    fail in that draw; ``shaped`` says whether its area allows a shape. A key holds n_bins times draws numbers, whatever the data's size.
    """
    start = math.floor(TAIL_FRACTION * n_bins)
    rows = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("t", "b")))).alias("m"))
    rows = rows.withColumn("none", F.transform(F.get(F.map_values("m"), F.lit(0))["t"], lambda v: F.lit(0).cast("long")))
    at = lambda k: F.coalesce(F.try_element_at("m", k), F.struct(F.col("none").alias("t"), F.col("none").alias("b")))
    bins = F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda k: F.struct(k.alias("bin"), at(k)["t"].alias("t"), at(k)["b"].alias("b")))
    rows = cut_lineage(rows.select(*keys, bins.alias("bins"), F.transform("none", lambda v: F.lit(0.0)).alias("zero")))

    def over(where, values):
        return F.aggregate(F.filter("bins", where), F.col("zero"), lambda a, x: F.zip_with(a, values(x), lambda p, q: p + q))

    t, b = lambda x: x["t"], lambda x: x["b"]
    tb = lambda x: F.zip_with(x["t"], x["b"], lambda p, q: p.cast("double") * q)
    bb = lambda x: F.transform(x["b"], lambda q: q.cast("double") * q)
    mid = lambda x: (x["bin"] + 0.5) * F.lit(width)
    whole, tail = lambda x: F.lit(True), lambda x: x["bin"] >= start
    main, next_ = lambda x: mid(x) < MAIN_UM, lambda x: (mid(x) >= MAIN_UM) & (mid(x) < TAIL_UM)
    sums = {"tp": over(whole, t), "bp": over(whole, b), "tt": over(tail, t), "bt": over(tail, b), "tb": over(tail, tb), "bb": over(tail, bb),
            "tm": over(main, t), "bm": over(main, b), "tn": over(next_, t), "bn": over(next_, b)}
    summed = rows.select(*keys, "bins", *[v.alias(n) for n, v in sums.items()])

    def fitted(z):
        raw = ratio(z["tb"] * z["bp"], z["bb"] * z["tp"])
        ok = (z["tt"] >= MIN_TAIL_PAIRS) & (z["bt"] >= MIN_TAIL_PAIRS)
        return F.struct(z["tp"].alias("tp"), z["bp"].alias("bp"), F.when(ok & raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).alias("beta"),
                        *[z[c].alias(c) for c in ("tm", "bm", "tn", "bn")])

    def metrics(z):
        share = lambda n, d: ratio(n, d)
        area = share(z["tp"], z["tp"]) - z["beta"] * share(z["bp"], z["bp"])
        main = share(z["tm"], z["tp"]) - z["beta"] * share(z["bm"], z["bp"])
        tail = share(z["tn"], z["tp"]) - z["beta"] * share(z["bn"], z["bp"])
        return F.struct(z["tp"].alias("tp"), z["bp"].alias("bp"), z["beta"].alias("beta"), area.alias("signed_area"), main.alias("main_mass"),
                        tail.alias("tail_mass"), F.when(main > MAIN_GUARD, tail / main).alias("tail_main_ratio"), (F.abs(area) > AREA_GUARD).alias("shaped"))

    fits = F.transform(F.transform(F.arrays_zip(*sums), fitted), metrics)
    return cut_lineage(summed.select(*keys, "bins", fits.alias("fit")))


def array_quantile(x: Column, p: float) -> Column:
    """Linear quantile of a sorted array without NULLs."""
    h = (F.size(x) - 1) * F.lit(float(p))
    low, high = F.get(x, F.floor(h).cast("int")), F.get(x, F.ceil(h).cast("int"))
    return low + (high - low) * (h - F.floor(h))


def over_sorted(values: Column, told) -> Column:
    """``told`` of the sorted non-NULL entries of an array; bound to a name, so the array is sorted once."""
    kept = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.get(F.transform(F.array(kept), told), F.lit(0))


def array_interval(values: Column, total: int, valid: float = MIN_VALID) -> Column:
    """(valid_draws, valid_fraction, low, high) of an array over draws: linear 2.5 and 97.5 percentiles, NULL below the share of valid draws."""

    def told(x):
        ok = F.size(x) >= F.lit(valid * total)
        return F.struct(F.size(x).cast("long").alias("valid_draws"), (F.size(x) / F.lit(float(total))).alias("valid_fraction"),
                        F.when(ok, array_quantile(x, PERCENTILES[0])).alias("low"), F.when(ok, array_quantile(x, PERCENTILES[2])).alias("high"))

    return over_sorted(values, told)


METRIC_NAMES = ("beta", "signed_area", "main_mass", "tail_mass", "tail_main_ratio")
FIELD_NAMES = ("total", "background", "inter", "intra", "shape")


def drawn_metrics(splits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, metric, values): each metric as an array over draws."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"fit.{m}").alias("values")) for m in METRIC_NAMES])
    return splits.select(*keys, F.inline(each))


def drawn_fields(splits: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """(keys, bin, field, values): densities of each curve field as arrays over draws, NULL where the field is unavailable in a draw."""
    rows = splits.select(*keys, "fit", F.explode("bins").alias("x")).select(*keys, "fit", "x.bin", "x.t", "x.b")

    def curve(z):
        total, background = ratio(z["t"], z["fit"]["tp"]), ratio(z["b"], z["fit"]["bp"])
        inter = z["fit"]["beta"] * background
        values = (total, background, inter, total - inter, F.when(z["fit"]["shaped"], (total - inter) / z["fit"]["signed_area"]))
        return F.struct(*[(v / F.lit(width)).alias(n) for n, v in zip(FIELD_NAMES, values)])

    rows = rows.select(*keys, "bin", F.transform(F.arrays_zip("t", "b", "fit"), curve).alias("c"))
    each = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"c.{n}").alias("values")) for n in FIELD_NAMES])
    return rows.select(*keys, "bin", F.inline(each))


def paired_draws(values: DataFrame, keys: Sequence[str], *, groups: tuple[str, str] = ("On", "Not-on")) -> DataFrame:
    """(keys, pairs): the two groups' values of the same draw, of the draws valid in both; keys that lack a group are left out."""
    side = lambda g: F.first(F.when(F.col("grp") == g, F.col("values")), ignorenulls=True)
    both = values.groupBy(*keys).agg(side(groups[0]).alias("a"), side(groups[1]).alias("b")).where("a is not null and b is not null")
    zipped = F.filter(F.zip_with("a", "b", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda z: z["a"].isNotNull() & z["b"].isNotNull())
    return both.select(*keys, zipped.alias("pairs"))


def interval(draws: DataFrame, keys: Sequence[str], value: str, *, total: int, point: Column | None = None) -> DataFrame:
    """2.5 and 97.5 percentiles, NULL unless enough draws are valid."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    out = draws.groupBy(*keys).agg(q.alias("q"), F.count(value).alias("valid_draws"))
    ok = F.col("valid_draws") >= F.lit(MIN_VALID * total)
    return out.select(*keys, "valid_draws", (F.col("valid_draws") / F.lit(float(total))).alias("valid_fraction"),
                      F.when(ok, F.col("q")[0]).alias("low"), F.when(ok, F.col("q")[1]).alias("high"))


def guard_by_point(intervals: DataFrame, points: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Attach the point estimate; without a finite point there is no interval."""
    p = points.select(*keys, F.col(value).alias("point"))
    has = F.col("point").isNotNull()
    return intervals.join(p, list(keys), "left").withColumns({"low": F.when(has, F.col("low")), "high": F.when(has, F.col("high"))})
