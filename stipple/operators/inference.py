"""Exact tests, multiplicity, effect sizes and distribution diagnostics on replicate means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipple.functions.columns import inverse_normal
from stipple.operators.skew import numbered
from stipple.session import cut_lineage

EPSILON = 2.220446049250313e-16
STATE_ROUNDS = 4  # values added between two written tables of states
EXACT = "decimal(28,9)"  # sums have decimal(30,9): a sum of decimals of 38 digits would lose its last digit


def planned_comparisons(means: DataFrame) -> DataFrame:
    """Proteins within a condition and condition pairs within a protein, per endpoint.

    ``means`` has one row per (endpoint, protein, condition, br). The result has both value
    lists; a list holds one mean per replicate.
    """
    lists = means.where("mean is not null").groupBy("endpoint", "protein", "condition").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("br", "mean"))), lambda s: s["mean"]).alias("values"), F.sum("n").alias("n_cells"))
    side = lambda s: lists.select("endpoint", *[F.col(c).alias(f"{c}_{s}") for c in ("protein", "condition", "values", "n_cells")])
    a, b = side("a"), side("b")
    within = lambda same, other: a.withColumn(f"{same}_b", F.col(f"{same}_a")).join(b, ["endpoint", f"{same}_b"]).where(
        F.col(f"{other}_a") < F.col(f"{other}_b"))
    columns = [f"{c}_{s}" for s in "ab" for c in ("protein", "condition", "values", "n_cells")]
    pairs = within("condition", "protein").select("endpoint", *columns, F.lit("proteins_within_condition").alias("kind")).unionByName(
        within("protein", "condition").select("endpoint", *columns, F.lit("conditions_within_protein").alias("kind")))
    name = F.concat(F.col("endpoint"), F.lit(":"), F.concat_ws("_", "protein_a", "condition_a"), F.lit("_minus_"), F.concat_ws("_", "protein_b", "condition_b"))
    return pairs.withColumn("comparison_id", name)


def half_states(c: DataFrame, key: str) -> DataFrame:
    """(key, half, size, left, n): how many subsets of a half of the values have a size and an exact sum.

    Value by value each state either takes the value or leaves it, and equal states are added up: 2 ** (n / 2) rows at most.
    """
    zero, wide = F.lit(0).cast("decimal(30,9)"), "decimal(30,9)"
    middle = F.ceil(F.size("v") / 2).cast("int")
    values = c.select(key, "na", "v", middle.alias("h"))
    states = values.select(key, F.explode(F.array(F.lit(0), F.lit(1))).alias("half"), F.lit(0).alias("size"), zero.alias("left"),
                           F.lit(1).cast("decimal(38,0)").alias("n"))
    longest = values.agg(F.coalesce(F.max("h"), F.lit(0))).first()[0]
    for i in range(longest):
        value = F.when(F.col("half") == 1, F.get("v", F.col("h") + i)).otherwise(F.when(F.col("h") > i, F.get("v", F.lit(i))))
        take = F.struct((F.col("size") + 1).alias("size"), (F.col("left") + value).cast(wide).alias("left"))
        leave = F.struct(F.col("size").alias("size"), F.col("left").alias("left"))
        grown = states.join(values, key).select(
            key, "half", "n", F.inline(F.when(value.isNotNull() & (F.col("size") < F.col("na")), F.array(leave, take)).otherwise(F.array(leave))))
        states = grown.groupBy(key, "half", "size", "left").agg(F.sum("n").cast("decimal(38,0)").alias("n"))
        if i % STATE_ROUNDS == STATE_ROUNDS - 1:
            states = cut_lineage(states)
    return states


def exact_permutation(comparisons: DataFrame, key: str = "comparison_id") -> DataFrame:
    """Two-sided exact permutation p of the difference of means over all partitions.

    Partitions are not listed: the effect grows with the exact sum of the values on the left, so a tail is the number of
    subsets up to a sum. The subsets of each half of the values are counted by (size, sum), and the halves meet in the middle: for each subset of
    one half a running count over the other, ordered by sum, gives the subsets that stay below the bound with it.
    Rows are 2 ** (n / 2) at most instead of 2 ** n, and no running count spans more than the subsets of one size of a half.
    p = min(1, 2 * smaller tail) with a relative tolerance on ties; equal exact sums are ties.
    """
    c = comparisons.select(
        key, F.size("values_a").alias("na"), F.size("values_b").alias("nb"),
        F.transform(F.concat("values_a", "values_b"), lambda v: F.round(v, 9).cast(EXACT)).alias("v"))
    c = cut_lineage(c)
    zero, wide = F.lit(0).cast("decimal(30,9)"), "decimal(30,9)"
    add = lambda s, v: (s + v).cast(wide)
    whole = c.withColumn("all", F.aggregate("v", zero, add)).withColumn("seen", F.aggregate(F.slice("v", F.lit(1), F.col("na")), zero, add))
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    obs = F.col("seen").cast("double") / na - (F.col("all") - F.col("seen")).cast("double") / nb
    whole = whole.where("na > 0 and nb > 0").withColumn("difference", obs)
    # the tolerance on the effect as a tolerance on sums, which are multiples of 1e-9
    slack = F.lit(100 * EPSILON) * F.greatest(F.abs("difference"), F.lit(1.0)) / (1 / na + 1 / nb)
    whole = cut_lineage(whole.select(key, "na", "difference", "seen", (F.floor(slack * 1e9).cast(wide) * F.lit("0.000000001").cast("decimal(10,9)")).cast(wide).alias("slack")))
    states = cut_lineage(half_states(c, key))
    count = "decimal(19,0)"
    left = states.where("half = 0").select(key, "size", F.col("left").alias("at"), F.lit(0).alias("asks"), F.col("n").cast(count).alias("n"), F.lit(0).cast(count).alias("times"))
    right = states.where("half = 1").join(whole, key).where(F.col("size") <= F.col("na"))
    bounds = F.array(*[F.struct(F.lit(k).alias("asks"), b.cast(wide).alias("at")) for k, b in (
        (1, F.col("seen") + F.col("slack") - F.col("left")), (2, F.col("seen") - F.col("slack") - F.lit("0.000000001").cast("decimal(10,9)") - F.col("left")),
        (3, F.lit("9" * 20).cast(wide)))])
    asked = right.select(key, (F.col("na") - F.col("size")).alias("size"), F.inline(bounds), F.lit(0).cast(count).alias("n"), F.col("n").cast(count).alias("times"))
    upto = Window.partitionBy(key, "size").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = left.unionByName(asked.select(left.columns)).withColumn("below", F.sum("n").over(upto).cast(count)).where("asks > 0")
    some = lambda k: F.coalesce(F.sum(F.when(F.col("asks") == k, F.col("below") * F.col("times")).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
    out = met.groupBy(key).agg(some(1).alias("lower"), some(2).alias("under"), some(3).alias("all")).join(whole, key)
    upper = F.col("all") - F.col("under")
    tail = F.least(F.col("lower").cast("double"), upper.cast("double")) / F.col("all").cast("double")
    return out.select(key, "difference", F.col("all").cast("long").alias("partitions"), F.least(F.lit(1.0), 2.0 * tail).alias("p_raw"))


def holm(tests: DataFrame, p: str = "p_raw", key: str = "comparison_id", *, family: Sequence[str] = ()) -> DataFrame:
    """Step-down adjustment within a family of planned tests (a short list by nature)."""
    part = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(1))
    order = part.orderBy(p, key)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.least(F.lit(1.0), (F.count("*").over(part) - F.row_number().over(order) + 1) * F.col(p))
    return tests.withColumn("__s", step).withColumn("p_holm", F.max("__s").over(upto)).drop("__s")


def effect_sizes(comparisons: DataFrame) -> DataFrame:
    """Difference, percent against the reference mean and ratio, NULL for a non-positive reference."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
    out = comparisons.withColumn("mean_a", mean("values_a")).withColumn("mean_b", mean("values_b"))
    usable = F.col("mean_b") > 0
    diff = F.col("mean_a") - F.col("mean_b")
    out = out.withColumns({
        "effect": diff, "relative_pct": F.when(usable, 100.0 * diff / F.col("mean_b")), "mean_ratio": F.when(usable, F.col("mean_a") / F.col("mean_b"))})
    agrees = F.abs(F.col("mean_ratio") - (1 + F.col("relative_pct") / 100)) <= 1e-12 * F.greatest(F.lit(1.0), F.abs("mean_ratio"))
    return out.withColumn("consistent", agrees)


def normality(df: DataFrame, keys: Sequence[str], value: str, *, order: Sequence[str]) -> DataFrame:
    """Moments, exact-rank Q-Q slope, intercept and correlation per group of any size.

    Plotting positions follow Filliben; skewness is bias-corrected.
    """
    keys = list(keys)
    usable = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    ranked = numbered(usable.select(*keys, value, *order), keys, [value, *order], "__i")
    size = usable.groupBy(*keys).agg(F.count("*").alias("__n"))
    n, i = F.col("__n").cast("double"), F.col("__i")
    last = F.pow(F.lit(0.5), 1.0 / n)
    place = F.when(i == 1, 1 - last).when(i == F.col("__n"), last).otherwise((i - 0.3175) / (n + 0.365))
    q = ranked.join(size, keys).withColumn("z", inverse_normal(place))
    g1 = F.skewness(value)
    k = F.count("*").cast("double")
    return q.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.when(k > 2, g1 * F.sqrt(k * (k - 1)) / (k - 2)).alias("skewness"),
        F.regr_slope(value, "z").alias("qq_slope"), F.regr_intercept(value, "z").alias("qq_intercept"), F.corr(value, "z").alias("qq_r"))


def guard_report(cells: DataFrame, endpoints: Sequence[str], *, expected_cells: int | None = None) -> DataFrame:
    """One row per check: are all endpoints valid, are counts conserved, is the cohort complete?"""
    conserved = F.col("on") + F.col("not_on") + F.col("unknown") + F.col("qc_excluded") == F.col("roi_candidates")
    one = cells.agg(
        F.count("*").alias("cells"), F.count_if(~F.coalesce(conserved, F.lit(False))).alias("counts_conserved"),
        *[F.count_if(F.col(e).isNull()).alias(f"valid_{e}") for e in endpoints])
    checks = [F.struct(F.lit(n).alias("check"), F.col(n).alias("failures")) for n in ("counts_conserved", *[f"valid_{e}" for e in endpoints])]
    if expected_cells is not None:
        checks.append(F.struct(F.lit("cohort_size").alias("check"), F.abs(F.col("cells") - expected_cells).alias("failures")))
    return one.select("cells", F.explode(F.array(*checks)).alias("c")).select("cells", "c.check", "c.failures", (F.col("c.failures") == 0).alias("ok"))
