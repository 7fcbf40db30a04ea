"""Connected regions of sparse masks, without gathering an image in one task.

Rows of a mask become horizontal runs, cut at the borders of square tiles. Regions are labelled
within each tile first; only labels that touch another tile go on, through groups of tiles that grow
level by level. No step depends on how long or winding a region is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipple.session import cut_lineage

MIN_REGION = 32  # Fixed value: smallest region kept, in pixels.
HOLE_LIMIT = 64  # Fixed value: enclosed holes below this size are filled.
TILE = 32
GROUP = 4


def row_runs(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal horizontal runs (keys, y, x0, x1) of the mask."""
    order = Window.partitionBy(*keys, "y").orderBy("x")
    island = mask.select(*keys, "y", "x").withColumn("__g", F.col("x") - F.row_number().over(order))
    return island.groupBy(*keys, "y", "__g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("__g")


def background_runs(mask: DataFrame, images: DataFrame, keys: Sequence[str], *, height: int, width: int) -> DataFrame:
    """Complement of the mask as runs, for every image listed in ``images``."""
    runs = row_runs(mask, keys).groupBy(*keys, "y").agg(F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("r"))
    rows = images.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    # a row holds at most width/2 runs; the gaps lie between one run's end and the next one's start
    r = F.coalesce("r", F.array().cast("array<struct<x0:int,x1:int>>"))
    starts = F.concat(F.array(F.lit(0)), F.transform(r, lambda s: s["x1"] + 1))
    ends = F.concat(F.transform(r, lambda s: s["x0"] - 1), F.array(F.lit(width - 1)))
    gaps = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("x0"), e.alias("x1"))), lambda g: g["x0"] <= g["x1"])
    return rows.join(runs, [*keys, "y"], "left").select(*keys, "y", F.explode(gaps).alias("g")).select(*keys, "y", "g.x0", "g.x1")


def tile_pieces(runs: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """Runs cut at tile borders: (keys, y, x0, x1, ty, tx)."""
    first, last = F.floor(F.col("x0") / tile).cast("int"), F.floor(F.col("x1") / tile).cast("int")
    cut = runs.select(*keys, "y", "x0", "x1", F.explode(F.sequence(first, last)).alias("tx"))
    return cut.select(*keys, "y", F.greatest("x0", F.col("tx") * tile).alias("x0"), F.least("x1", F.col("tx") * tile + tile - 1).alias("x1"),
                      F.floor(F.col("y") / tile).cast("int").alias("ty"), "tx")


def tile_labels(pieces: DataFrame, keys: Sequence[str], *, width: int, slack: int) -> DataFrame:
    """``label`` of each piece within its own tile: one fold over the tile's pieces in reading order.

    A piece takes the smallest label among those it touches in the row above, and they take it too. A tile has at most
    half as many pieces as pixels, so the array is bounded whatever the image holds.
    """
    ident = (F.col("y") * width + F.col("x0")).cast("bigint")
    piece = F.struct("y", "x0", "x1", ident.alias("label"))
    tiles = pieces.groupBy(*keys, "ty", "tx").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))

    def grow(done, new):
        above = F.filter(done, lambda d: (d["y"] == new["y"] - 1) & (d["x0"] <= new["x1"] + slack) & (new["x0"] <= d["x1"] + slack))
        near = F.array_append(F.transform(above, lambda d: d["label"]), new["label"])

        def relabelled(d, labels):
            label = F.when(F.array_contains(labels, d["label"]), F.array_min(labels)).otherwise(d["label"])
            return F.struct(d["y"].alias("y"), d["x0"].alias("x0"), d["x1"].alias("x1"), label.alias("label"))

        # an array of one element binds the touched labels to a name
        return F.transform(F.array(near), lambda labels: F.transform(F.array_append(done, new), lambda d: relabelled(d, labels)))[0]

    none = F.slice("pieces", 1, 0)
    return tiles.select(*keys, "ty", "tx", F.explode(F.aggregate("pieces", none, grow)).alias("p")).select(*keys, "ty", "tx", "p.*")


def border_links(labelled: DataFrame, keys: Sequence[str], *, tile: int, slack: int) -> DataFrame:
    """(keys, u, v, ay, ax, by, bx): labels of two tiles that touch, with both tiles. Only pieces at borders take part."""
    here = [F.col("label").alias("u"), F.col("ty").alias("ay"), F.col("tx").alias("ax")]
    there = [F.col("label").alias("v"), F.col("ty").alias("by"), F.col("tx").alias("bx")]
    top = labelled.where(F.col("y") % tile == 0).select(*keys, "y", "x0", "x1", *here)
    bottom = labelled.where(F.col("y") % tile == tile - 1).select(
        *keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), *there)
    down = top.join(bottom, [*keys, "y"]).where((F.col("x0") <= F.col("bx1") + slack) & (F.col("bx0") <= F.col("x1") + slack))
    # sideways: the same row, and for diagonal contact the rows beside it within the same row of tiles
    right = labelled.where(F.col("x0") % tile == 0).select(*keys, "y", F.col("x0").alias("x"), *here)
    beside = F.explode(F.sequence(F.col("y") - slack, F.col("y") + slack))
    left = labelled.where(F.col("x1") % tile == tile - 1).select(*keys, beside.alias("y"), (F.col("x1") + 1).alias("x"), *there)
    across = right.join(left, [*keys, "y", "x"]).where("ay = by")
    names = [*keys, "u", "v", "ay", "ax", "by", "bx"]
    return down.select(*names).unionByName(across.select(*names)).distinct()


def merged_labels(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, label) of the labels that change when the linked ``u``, ``v`` of each group of tiles become one."""
    links = pairs.groupBy(*keys, "gy", "gx").agg(F.collect_set(F.struct("u", "v")).alias("links"))
    ids = F.array_union(F.transform("links", lambda e: e["u"]), F.transform("links", lambda e: e["v"]))

    def join_pair(known, e):
        both = F.array(known[e["u"]], known[e["v"]])
        return F.transform(F.array(both), lambda ends: F.when(ends[0] == ends[1], known).otherwise(
            F.transform_values(known, lambda _, label: F.when(label == F.array_max(ends), F.array_min(ends)).otherwise(label))))[0]

    known = F.aggregate("links", F.map_from_arrays(ids, ids), join_pair)
    return links.select(*keys, F.explode(known).alias("id", "label")).where("id <> label")


def label_runs(runs: DataFrame, keys: Sequence[str], *, width: int, diagonal: bool, height: int | None = None, tile: int = TILE) -> DataFrame:
    """Runs cut at tile borders with ``component``: the smallest pixel number y * width + x of the connected region.

    Regions are labelled within tiles in one stage. Links between tiles are then settled in levels: those within
    4 x 4 tiles, those within 16 x 16 tiles and so on, each level in one task for a group of tiles. The number of levels, and of
    jobs, depends on the size of the image alone; an image of one tile needs none.
    """
    keys = list(keys)
    slack = 1 if diagonal else 0
    labelled = tile_labels(tile_pieces(runs, keys, tile), keys, width=width, slack=slack)
    if height is not None and max(height, width) <= tile:
        return labelled.select(*keys, "y", "x0", "x1", F.col("label").alias("component"))
    labelled = cut_lineage(labelled)
    links = border_links(labelled, keys, tile=tile, slack=slack)
    side = lambda a, b, k: F.floor(F.col(a) / GROUP**k) == F.floor(F.col(b) / GROUP**k)
    extent = labelled.agg(F.max("ty"), F.max("tx")).first() if height is None else (
        (height - 1) // tile, (width - 1) // tile)
    levels = 0
    while GROUP**levels <= max(extent[0] or 0, extent[1] or 0):
        levels += 1
    links = cut_lineage(links)
    final = links.select(*keys, F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("label", F.col("id"))
    for k in range(1, levels + 1):
        inside = side("ay", "by", k) & side("ax", "bx", k)
        group = [F.floor(F.col("ay") / GROUP**k).alias("gy"), F.floor(F.col("ax") / GROUP**k).alias("gx")]
        changed = cut_lineage(merged_labels(links.where(inside).select(*keys, *group, "u", "v"), keys))
        final = renamed(final, changed, keys, "label")
        if k < levels:
            links = cut_lineage(renamed(renamed(links.where(~inside), changed, keys, "u"), changed, keys, "v"))
    final = final.where("id <> label").select(*keys, F.col("id").alias("label"), F.col("label").alias("component"))
    return labelled.join(final, [*keys, "label"], "left").select(*keys, "y", "x0", "x1", F.coalesce("component", "label").alias("component"))


def renamed(df: DataFrame, changed: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``name`` replaced by its new label where it has one."""
    new = changed.select(*keys, F.col("id").alias(name), F.col("label").alias("__new"))
    return df.join(new, [*keys, name], "left").withColumn(name, F.coalesce("__new", name)).select(*df.columns)


def spread(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs back to pixels."""
    return runs.select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def component_areas(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    return labelled.groupBy(*keys, "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))


def keep_large(
    mask: DataFrame, keys: Sequence[str], *, width: int, height: int | None = None, minimum: int = MIN_REGION, tile: int = TILE
) -> DataFrame:
    """Pixels of 8-connected regions with at least ``minimum`` pixels."""
    labelled = label_runs(row_runs(mask, keys), keys, width=width, height=height, diagonal=True, tile=tile)
    large = component_areas(labelled, keys).where(F.col("area") >= minimum)
    return spread(labelled.join(large.select(*keys, "component"), [*keys, "component"], "left_semi"), keys)


def enclosed_holes(
    mask: DataFrame, keys: Sequence[str], *, height: int, width: int, limit: int = HOLE_LIMIT, tile: int = TILE
) -> DataFrame:
    """Pixels of 4-connected background regions below ``limit`` that do not reach the image edge."""
    images = mask.select(*keys).distinct()
    labelled = label_runs(background_runs(mask, images, keys, height=height, width=width), keys, width=width, height=height,
                          diagonal=False, tile=tile)
    edge = (F.col("y") == 0) | (F.col("y") == height - 1) | (F.col("x0") == 0) | (F.col("x1") == width - 1)
    judged = labelled.groupBy(*keys, "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.bool_or(edge).alias("open"))
    holes = judged.where(~F.col("open") & (F.col("area") < limit))
    return spread(labelled.join(holes.select(*keys, "component"), [*keys, "component"], "left_semi"), keys)


def fill_holes(mask: DataFrame, keys: Sequence[str], *, height: int, width: int, limit: int = HOLE_LIMIT) -> DataFrame:
    """The mask with its small enclosed holes; ``filled`` marks added pixels."""
    holes = enclosed_holes(mask, keys, height=height, width=width, limit=limit)
    return mask.select(*keys, "y", "x", F.lit(False).alias("filled")).unionByName(holes.withColumn("filled", F.lit(True)))


def clean_mask(supported: DataFrame, keys: Sequence[str], *, height: int, width: int, minimum: int = MIN_REGION, limit: int = HOLE_LIMIT) -> DataFrame:
    """Support mask to final mask: drop small regions, then fill small holes."""
    kept = cut_lineage(keep_large(supported, keys, width=width, height=height, minimum=minimum))
    return fill_holes(kept, keys, height=height, width=width, limit=limit)
