"""Building blocks that stay whole and balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipple.session import cut_lineage

BROADCAST_ROWS = 100_000
QUANTILE_SLICES = 4096
FIRST_SLICES = 256  # of the cut over rows that are not counted yet: every task may hold that many counts for each group
ORDERED_VALUES = 200_000


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Measured size test before a broadcast; stops reading after ``rows`` + 1 rows."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only behind a measured size; otherwise the planner shuffles the join."""
    return F.broadcast(df) if small_enough(df, rows) else df


def with_totals(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Attach per-key aggregates without a window, so a hot key is combined map-side first.

    ``keys`` may hold NULLs; they match each other.
    """
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    renamed = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], *aggregates)
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(renamed, on, "left").drop(*[f"__{k}" for k in keys])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """1-based position of each row within its key, by ``order``, for keys of any size.

    A global range sort splits hot keys across tasks; per-task counts then give each
    (key, task) its offset. The sorted rows are checkpointed because both uses must see
    the same task boundaries.
    """
    placed = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("__pos", F.monotonically_increasing_id())
    )
    placed = cut_lineage(placed.withColumn("__task", F.shiftright("__pos", 33)))
    runs = placed.groupBy(*keys, "__task").agg(F.count("*").alias("__n"), F.min("__pos").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "__task", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__skip"))
    return placed.join(runs, [*keys, "__task"]).select(
        *df.columns, (F.col("__skip") + F.col("__pos") - F.col("__first") + 1).cast("bigint").alias(name)
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], *, slices: int = QUANTILE_SLICES,
    ordered: int = ORDERED_VALUES, reread: bool = False,
) -> DataFrame:
    """Exact linear-interpolated quantiles per key: rows of (keys, prob, quantile).

    Values are counted by (key, value). A group of more than ``ordered`` distinct values is cut
    into equal slices whose counts locate the wanted ranks, and only slices that hold such a rank stay, as
    groups of the next round. Each round narrows the range ``slices`` times, so far outliers cost
    a round and no task ever orders more than ``ordered`` values of a group. The smallest and the largest value of
    a group fall into different slices, so every round leaves fewer values and rounds end.

    Infinities stand at their ends and NaN above them, as in a sort; they take their ranks without entering a slice. A quantile
    between two values of which one is infinite or NaN is that one, unless its rank is whole.

    With ``reread`` the first cut of large groups reads the rows of ``df``, which must be the same each time, instead of their counts by
    value: most rows lie in slices that no rank falls into, so only few are ever counted by value.
    """
    keys = list(keys)
    slices = max(2, slices)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"), F.lit(1).cast("bigint").alias("__w"), F.lit(0).cast("bigint").alias("__g"))

    def by_value(rows):
        return cut_lineage(rows.groupBy(*keys, "__g", "__v").agg(F.sum("__w").alias("__w")))

    counted = rows if reread else by_value(rows)
    real = counted.schema["__v"].dataType.typeName() in ("double", "float")
    ends = {"__nan": F.isnan("__v"), "__top": F.col("__v") == F.lit(float("inf")), "__low": F.col("__v") == F.lit(float("-inf"))} if real else {}
    odd = {n: F.coalesce(F.sum(F.when(c, F.col("__w"))), F.lit(0)) if ends else F.lit(0).cast("bigint") for n, c in ends.items()}
    odd = odd or {n: F.max(F.lit(0).cast("bigint")) for n in ("__nan", "__top", "__low")}
    inner_v = F.when(~F.isnan("__v") & (F.abs("__v") < F.lit(float("inf"))), F.col("__v")) if real else F.col("__v")
    totals = counted.groupBy(*keys).agg(
        F.sum("__w").alias("__n"), *[c.alias(n) for n, c in odd.items()], F.min(inner_v).alias("__lo"), F.max(inner_v).alias("__hi"), F.count(inner_v).alias("__d"))
    if reread:
        totals = cut_lineage(totals)
    if real:
        counted = counted.where(~F.isnan("__v") & (F.abs("__v") < F.lit(float("inf"))))
    place = [(F.col("__n") - 1) * F.lit(float(p)) for p in probs]
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("prob"), h.alias("at"), F.floor(h).alias("lo"), F.ceil(h).alias("hi"))
                       for p, h in zip(probs, place)])
    asked = totals.select(*keys, F.inline(wanted), "__n", *odd)
    inside_ranks = (F.col("__rank") >= F.col("__low")) & (F.col("__rank") < F.col("__n") - F.col("__nan") - F.col("__top"))
    ranks = asked.select(*keys, "__n", *odd, F.explode(F.array("lo", "hi")).alias("__rank")).distinct()
    named = F.when(F.col("__rank") < F.col("__low"), F.lit(float("-inf"))).when(
        F.col("__rank") < F.col("__n") - F.col("__nan"), F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    outside = ranks.where(~inside_ranks).select(*keys, "__rank", named.alias("__v"))
    targets = ranks.where(inside_ranks).select(*keys, "__rank", F.lit(0).cast("bigint").alias("__g"), F.col("__low").alias("__base"))
    group = [*keys, "__g"]
    while True:
        spread = totals.where("__d > 0").select(*keys, F.lit(0).cast("bigint").alias("__g"), "__lo", "__hi", "__d") if reread else counted.groupBy(*group).agg(
            F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count("*").alias("__d"))
        largest = spread.agg(F.max("__d")).first()[0] or 0
        if largest <= ordered:
            counted = by_value(counted) if reread else counted
            break
        n = min(slices, FIRST_SLICES) if reread else slices
        # each term is divided first: the difference of two very large values has no double
        low, width = F.col("__lo") / F.lit(float(n)), F.col("__hi") / F.lit(float(n)) - F.col("__lo") / F.lit(float(n))
        part = F.when(F.col("__v") >= F.col("__hi"), F.lit(n - 1)).when(F.col("__v") <= F.col("__lo"), F.lit(0)).when(
            width > 0, F.least(F.floor((F.col("__v") / F.lit(float(n)) - low) / width * n), F.lit(n - 1))).otherwise(F.lit(0)).cast("int")
        sliced = counted.join(broadcast_if_small(spread) if reread else spread, group).withColumn("__s", part)
        sums = sliced.groupBy(*group, "__s").agg(F.sum("__w").alias("__sw"))
        upto = Window.partitionBy(*group).orderBy("__s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("__end", F.sum("__sw").over(upto)).withColumn("__start", F.col("__end") - F.col("__sw"))
        rank = F.col("__rank") - F.col("__base")
        hit = targets.join(sums, group).where((rank >= F.col("__start")) & (rank < F.col("__end")))
        inner = F.xxhash64("__g", "__s")
        targets = cut_lineage(hit.select(*group, "__s", "__rank", (F.col("__base") + F.col("__start")).alias("__base")))
        wanted_slices = targets.select(*group, "__s").distinct()
        counted = sliced.join(broadcast_if_small(wanted_slices) if reread else wanted_slices, [*group, "__s"]).select(*keys, inner.alias("__g"), "__v", "__w")
        counted = by_value(counted) if reread else cut_lineage(counted)
        targets, reread = targets.select(*keys, inner.alias("__g"), "__rank", "__base"), False
    inside = Window.partitionBy(*group).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counted.withColumn("__e", F.sum("__w").over(inside))
    rank = F.col("__rank") - F.col("__base")
    found = targets.join(upto, group).where((rank < F.col("__e")) & (rank >= F.col("__e") - F.col("__w"))).select(*keys, "__rank", "__v")
    found = found.unionByName(outside) if real else found
    low = found.select(*keys, F.col("__rank").alias("lo"), F.col("__v").alias("__l"))
    high = found.select(*keys, F.col("__rank").alias("hi"), F.col("__v").alias("__h"))
    both = asked.join(low, [*keys, "lo"]).join(high, [*keys, "hi"])
    part = F.col("at") - F.col("lo")
    between = F.col("__l") + (F.col("__h") - F.col("__l")) * part
    if real:
        endless = lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
        between = F.when((part == 0) | endless("__l") & ~endless("__h"), F.col("__l")).when(endless("__h"), F.col("__h")).otherwise(between)
    return both.select(*keys, "prob", between.alias("quantile"))
