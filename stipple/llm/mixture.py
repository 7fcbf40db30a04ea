"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents are summed to cells of (source, lang, topic). The cells' token weights are scaled in turn
to the target share of each source, each language and each topic; rounds of this rake
the weights to all three marginals. A cell never weighs more than its tokens: the factor of a value is the target less what its
cells at that bound weigh, over what its free cells weigh, a Newton step on a concave sum, so rounds settle on the factors under
which the bounded cells meet the target. A document of a cell is kept with the probability weight over tokens, which
gives the cell its weight in expected tokens and the sample its budget.
A value cannot give more tokens than it has; what its target asks beyond that goes to the other values of the
dimension. ``attained`` lists wanted, reachable and attained shares, the rounds and whether they settled: rounds end at ``CLOSE`` of
the budget, when they no longer gain, or after ``MAX_ROUNDS``. Targets that no weights can meet together end so.
Whether a document is kept depends on its id and the seed alone.

Only DataFrame operations are used. Cells are sums, so a source with a third of all rows is combined
before it moves. Up to ``CELLS_A_TASK`` cells (measured) are raked in one job, as arrays of cells by value in a fold over the rounds; more are raked
by a grouping by value and a join of the values' sums for each step, so a topic of any number of cells stays spread.

Null and empty texts have no tokens and belong to the topic ``empty``; their cell weighs nothing and
its documents are kept with the sampled share of all tokens as probability. Null sources
and languages are values of their own, ``(none)``. Values without a target or with one of zero are left out of the sample. A null doc_id is drawn as the empty id. Repeated
rows are drawn alike. Other columns are never looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipple.llm.registry import named, table
from stipple.llm.shared import written

SHARE = 0.5
TEMPER = 0.5
SEED = "mix"
DIMS = ("__source", "__lang", "__topic")
CELLS_A_TASK = 50_000
MAX_ROUNDS = 240
CLOSE = 1e-12
SETTLED = 1e-6  # share of the budget that counts as met
DIGITS = 6


def topic_of(text: Column) -> Column:
    """A coarse topic by the form of the text."""
    low = F.lower(text)
    return (
        F.when(F.length(text) == 0, "empty")
        .when(text.contains(" | "), "tabular")
        .when(low.contains("licensed under") | low.contains("copyright"), "legal")
        .when(text.contains("@") | text.contains("http"), "contact")
        .when(text.contains("###") | text.contains("%%%"), "symbolic")
        .otherwise("prose")
    )


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def dims(source_col: str, lang_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.coalesce(F.col(source_col).cast("string"), F.lit("(none)")).alias(DIMS[0]),
            F.coalesce(F.col(lang_col).cast("string"), F.lit("(none)")).alias(DIMS[1]), topic_of(text).alias(DIMS[2])]


def draw(id_col: str, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def tempered(cells: DataFrame, temper: float = TEMPER) -> dict[str, DataFrame]:
    """Targets that flatten the present marginals: shares of tokens to the power ``temper``; topics alike."""
    out = {}
    for dim, power in zip(DIMS, (temper, temper, 0.0)):
        sums = cells.where("tokens > 0").groupBy(dim).agg(F.sum("tokens").alias("t"))
        out[dim] = sums.select(dim, F.pow(F.col("t").cast("double"), F.lit(power)).alias("target"))
    return out


def reachable(cells: DataFrame, targets: dict[str, DataFrame], budget: float) -> DataFrame:
    """(dim, value, wanted, target): tokens that the targets ask for, and those that the input can give.

    No value can give more tokens than it has; what such a value leaves open goes to the others in
    proportion to their targets. Each step adds the values that are now full; three rows come to the driver.
    """
    values = None
    for k, (dim, target) in enumerate(targets.items()):
        sums = cells.where("tokens > 0").groupBy(dim).agg(F.sum("tokens").cast("double").alias("tokens"))
        rows = sums.join(target.select(dim, F.col("target").cast("double").alias("w")), dim).where(F.col("w") > 0)
        rows = rows.select(F.lit(k).alias("dim"), F.col(dim).alias("value"), "tokens", "w")
        values = rows if values is None else values.unionByName(rows)
    values = written(values)
    scale, first, full = {}, {}, None
    while True:
        at = F.lit(False) if full is None else F.col("w") * by_dim(scale) >= F.col("tokens")
        sums = {r["dim"]: r for r in values.groupBy("dim").agg(
            F.sum(F.when(at, F.col("tokens")).otherwise(0.0)).alias("full"), F.sum(F.when(at, 0.0).otherwise(F.col("w"))).alias("w"),
            F.count(F.when(at, 1)).alias("n")).collect()}
        if full is not None and full == [r["n"] for _, r in sorted(sums.items())]:
            break
        full = [r["n"] for _, r in sorted(sums.items())]
        scale = {k: max(0.0, budget - r["full"]) / r["w"] if r["w"] else scale.get(k, 0.0) for k, r in sums.items()}
        first = first or scale
    at = F.col("w") * by_dim(scale) >= F.col("tokens")
    return written(values.select("dim", "value", (F.col("w") * by_dim(first)).alias("wanted"),
                                 F.when(at, F.col("tokens")).otherwise(F.col("w") * by_dim(scale)).alias("target")))


def by_dim(numbers: dict[int, float]) -> Column:
    out = F.lit(0.0)
    for k, number in numbers.items():
        out = F.when(F.col("dim") == k, F.lit(float(number))).otherwise(out)
    return out


def factor(target: Column, full: Column, free: Column) -> Column:
    """A Newton step towards the factor of a value, or the plain ratio where its full cells alone pass the target."""
    return F.when((free > 0) & (target > full), (target - full) / F.when(free > 0, free)).otherwise(
        target / F.when(full + free > 0, full + free))


def joined_step(cells: DataFrame, dim: str) -> DataFrame:
    at = F.col("weight") >= F.col("tokens")
    sums = cells.groupBy(dim).agg(F.sum(F.when(at, F.col("tokens").cast("double")).otherwise(0.0)).alias("__full"),
                                  F.sum(F.when(at, 0.0).otherwise(F.col("weight"))).alias("__free"))
    scaled = F.col("weight") * factor(F.col(f"{dim}_t"), F.col("__full"), F.col("__free"))
    return written(cells.join(sums, dim).withColumn("weight", scaled).drop("__full", "__free"))


def folded(cells: DataFrame, rounds: int) -> DataFrame:
    """``cells`` after ``rounds``, in one job: a row holds the cells by value of each dimension, the state is a factor for each value."""
    for k, dim in enumerate(DIMS):
        cells = cells.withColumn(f"c{k}", F.dense_rank().over(Window.orderBy(dim)) - 1)  # a measured, small number of cells
    cell = F.struct(F.col("tokens").cast("double").alias("tokens"), "weight", "c0", "c1", "c2", F.struct(*[c for c in cells.columns if c not in ("weight", "c0", "c1", "c2")]).alias("own"))
    cells = written(cells.select(cell.alias("cell"), *[F.col(f"{d}_t").alias(f"t{k}") for k, d in enumerate(DIMS)]))
    lists = None
    for k in range(3):
        rows = cells.groupBy(F.lit(k).alias("dim"), F.col(f"cell.c{k}").alias("code")).agg(F.first(f"t{k}").alias("target"), F.collect_list("cell").alias("cells"))
        lists = rows if lists is None else lists.unionByName(rows)
    by = [F.sort_array(F.collect_list(F.when(F.col("dim") == k, F.struct("code", "target", "cells")))).alias(f"v{k}") for k in range(3)]
    row = written(lists.groupBy().agg(*by))

    def weight(c, state):
        return c["weight"] * F.get(state["f0"], c["c0"]) * F.get(state["f1"], c["c1"]) * F.get(state["f2"], c["c2"])

    def summed(state):
        def add(acc, c):
            at = weight(c, state) >= c["tokens"]
            return F.struct((acc["full"] + F.when(at, c["tokens"]).otherwise(0.0)).alias("full"),
                            (acc["free"] + F.when(at, 0.0).otherwise(weight(c, state))).alias("free"))
        return add

    def scaled(k, state):
        zero = F.struct(F.lit(0.0).alias("full"), F.lit(0.0).alias("free"))
        sums = F.transform(f"v{k}", lambda v: F.struct(v["target"].alias("target"), F.aggregate(v["cells"], zero, summed(state)).alias("s")))
        grown = F.transform(sums, lambda v: factor(v["target"], v["s"]["full"], v["s"]["free"]))
        return F.zip_with(state[f"f{k}"], grown, lambda f, g: f * g)

    start = F.struct(*[F.transform(f"v{k}", lambda v: F.lit(1.0)).alias(f"f{k}") for k in range(3)])
    one = lambda state, i: F.struct(*[F.when(i % 3 == k, scaled(k, state)).otherwise(state[f"f{k}"]).alias(f"f{k}") for k in range(3)])
    end = row.select("v0", F.aggregate(F.sequence(F.lit(0), F.lit(3 * rounds - 1)), start, one).alias("end"))
    each = end.select(F.explode("v0.cells").alias("cells"), "end").select(F.explode("cells").alias("c"), "end")
    return each.select("c.own.*", weight(F.col("c"), F.col("end")).alias("weight"))


def gap(cells: DataFrame) -> float:
    """The largest difference of a marginal from its target, in tokens."""
    held = F.least(F.col("weight"), F.col("tokens").cast("double")).alias("held")
    each = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value"), F.col(f"{d}_t").alias("t"), held) for d in DIMS])
    sums = cells.select(F.inline(each)).groupBy("dim", "value").agg(F.abs(F.sum("held") - F.first("t")).alias("gap"))
    return sums.agg(F.max("gap")).first()[0] or 0.0


def raked(cells: DataFrame, goals: DataFrame, budget: float, cells_a_task: int = CELLS_A_TASK) -> tuple[DataFrame, dict]:
    """``cells`` with tokens and targets with a ``weight`` raked to all ``goals``, and {rounds, gap, settled}."""
    cells = cells.where("tokens > 0").withColumn("weight", F.col("tokens") * F.lit(float(budget)) / F.lit(max(1.0, float(total_of(cells)))))
    for k, dim in enumerate(DIMS):
        cells = cells.join(goals.where(F.col("dim") == k).select(F.col("value").alias(dim), F.col("target").alias(f"{dim}_t")), dim)
    cells = written(cells)
    if cells.count() <= cells_a_task:
        names = [c for c in cells.columns if c != "weight"]
        cells = written(folded(cells.select(*names, "weight"), MAX_ROUNDS).select(*names, "weight"))
        rounds, now = MAX_ROUNDS, gap(cells) / max(budget, 1e-300)
    else:
        rounds, now, last = 0, float("inf"), float("inf")
        while rounds < MAX_ROUNDS and now > CLOSE and not (now <= SETTLED and now > 0.5 * last):
            for dim in DIMS:
                cells = joined_step(cells, dim)
            rounds, last, now = rounds + 1, now, gap(cells) / max(budget, 1e-300)
    held = F.least(F.col("weight"), F.col("tokens").cast("double"))
    return cells.withColumn("weight", held).drop(*[f"{d}_t" for d in DIMS]), {"rounds": rounds, "gap": now, "settled": now <= SETTLED}


def total_of(cells: DataFrame) -> int:
    return cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]


def chances_of(slim: DataFrame, share: float, targets, cells_a_task: int = CELLS_A_TASK) -> tuple[DataFrame, DataFrame, dict]:
    """Cells with their probability; goals; how the rounds ended. Cells without tokens keep ``share``, those without a target nothing."""
    cells = written(slim.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))
    budget = share * float(total_of(cells))
    goals = reachable(cells, (targets or tempered)(cells), budget)
    weighted, end = raked(cells, goals, budget, cells_a_task)
    found = cells.join(weighted.select(*DIMS, "weight"), list(DIMS), "left")
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.coalesce("weight", F.lit(0.0)) / F.col("tokens"))).otherwise(F.lit(share))
    return written(found.select(*DIMS, "tokens", F.round(chance, DIGITS).alias("probability"))), goals, end | {"budget": budget}


def mixed_rows(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang",
               text_col: str = "text", share: float = SHARE, targets=None, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, probability, kept.

    ``targets`` gives for the cells a DataFrame (value, target) for each of DIMS; by default the
    present shares are tempered. ``share`` is the part of all tokens that the sample should have.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = written(docs.select(F.col(id_col).alias("doc_id"), *dims(source_col, lang_col, text_col), n_words(text).alias("n_tokens")))
    chances, _, _ = chances_of(slim, share, targets)
    found = slim.join(chances.drop("tokens"), list(DIMS), "left")
    return found.select(
        "doc_id", F.col(DIMS[0]).alias("source"), F.col(DIMS[1]).alias("lang"), F.col(DIMS[2]).alias("topic"), "n_tokens",
        "probability", (draw("doc_id", seed) < F.col("probability")).alias("kept"))


def attained(docs: DataFrame, *, source_col: str = "source", lang_col: str = "lang", text_col: str = "text",
             share: float = SHARE, targets=None) -> DataFrame:
    """One row per value of each dimension: dimension, value, wanted, reachable, attained (shares of the budget), rounds, settled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = written(docs.select(*dims(source_col, lang_col, text_col), n_words(text).alias("n_tokens")))
    chances, goals, end = chances_of(slim, share, targets)
    each = F.array(*[F.struct(F.lit(k).alias("dim"), F.col(d).alias("value"), (F.col("tokens") * F.col("probability")).alias("got")) for k, d in enumerate(DIMS)])
    got = chances.where("tokens > 0").select(F.inline(each)).groupBy("dim", "value").agg(F.sum("got").alias("got"))
    name = F.get(F.array(*[F.lit(d.strip("_")) for d in DIMS]), F.col("dim"))
    return goals.join(got, ["dim", "value"], "left").select(
        name.alias("dimension"), "value", (F.col("wanted") / end["budget"]).alias("wanted"), (F.col("target") / end["budget"]).alias("reachable"),
        (F.coalesce("got", F.lit(0.0)) / end["budget"]).alias("attained"), F.lit(end["rounds"]).alias("rounds"), F.lit(end["settled"]).alias("settled"))


def sample_to_targets(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang",
                      text_col: str = "text", share: float = SHARE, targets=None, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` that the mixture keeps; all columns stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = dims(source_col, lang_col, text_col)
    chances, _, _ = chances_of(docs.select(*own, n_words(text).alias("n_tokens")), share, targets)
    rows = docs.select(F.struct("*").alias("__row"), draw(id_col, seed).alias("__draw"), *own)  # columns of the rows can't clash inside
    found = rows.join(chances.drop("tokens"), list(DIMS), "left")
    return found.where(F.col("__draw") < F.col("probability")).select("__row.*")


def oracle() -> str:
    """The same in SQL: reachable targets by the order in which values fill up, then a recursive query of MAX_ROUNDS rounds."""
    goals = []
    for dim, power in (("source", TEMPER), ("lang", TEMPER), ("topic", 0.0)):
        goals.append(f"""
{dim}_v AS (SELECT {dim}, CAST(sum(tokens) AS DOUBLE) AS tok, power(CAST(sum(tokens) AS DOUBLE), {power}) AS w FROM live GROUP BY 1),
{dim}_o AS (SELECT *, sum(tok) OVER upto + tok / w * (sum(w) OVER () - sum(w) OVER upto) <= (SELECT b FROM budget) * (1 + 1e-12) AS is_full
  FROM {dim}_v WINDOW upto AS (ORDER BY tok / w RANGE UNBOUNDED PRECEDING)),
{dim}_g AS (SELECT {dim}, CASE WHEN is_full THEN tok ELSE w * ((SELECT b FROM budget) - coalesce((SELECT sum(tok) FROM {dim}_o WHERE is_full), 0))
  / (SELECT sum(w) FROM {dim}_o WHERE NOT is_full) END AS {dim}_t FROM {dim}_o)""")
    step = "rounds"
    for dim in ("source", "lang", "topic"):
        full = f"sum(CASE WHEN w >= tokens THEN tokens ELSE 0 END) OVER (PARTITION BY {dim})"
        free = f"sum(CASE WHEN w >= tokens THEN 0 ELSE w END) OVER (PARTITION BY {dim})"
        where = f" WHERE r < {MAX_ROUNDS}" if step == "rounds" else ""
        step = (f"(SELECT r, source, lang, topic, tokens, source_t, lang_t, topic_t, w * CASE WHEN free > 0 AND {dim}_t > filled THEN ({dim}_t - filled) / free"
                f" ELSE {dim}_t / (filled + free) END AS w FROM (SELECT *, {full} AS filled, {free} AS free FROM {step}{where}))")
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS t FROM documents),
slim AS (
  SELECT doc_id, source, lang, CASE WHEN t = '' THEN 'empty' WHEN contains(t, ' | ') THEN 'tabular'
    WHEN contains(lower(t), 'licensed under') OR contains(lower(t), 'copyright') THEN 'legal'
    WHEN contains(t, '@') OR contains(t, 'http') THEN 'contact'
    WHEN contains(t, '###') OR contains(t, '%%%') THEN 'symbolic' ELSE 'prose' END AS topic,
    CAST(len(regexp_extract_all(t, '[^ 	-
]+')) AS BIGINT) AS n_tokens FROM d),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM slim GROUP BY ALL),
live AS (SELECT source, lang, topic, CAST(tokens AS DOUBLE) AS tokens FROM cells WHERE tokens > 0),
budget AS (SELECT {SHARE} * sum(tokens) AS b FROM live), {','.join(goals)},
rounds AS (SELECT 0 AS r, source, lang, topic, tokens, source_t, lang_t, topic_t, tokens * {SHARE} AS w
    FROM live JOIN source_g USING (source) JOIN lang_g USING (lang) JOIN topic_g USING (topic)
  UNION ALL SELECT r + 1, source, lang, topic, tokens, source_t, lang_t, topic_t, w FROM {step}),
p AS (SELECT source, lang, topic, round(least(1.0, w / tokens), {DIGITS}) AS p FROM rounds WHERE r = {MAX_ROUNDS}),
x AS (SELECT slim.*, CASE WHEN p IS NOT NULL THEN p ELSE {SHARE} END AS probability FROM slim LEFT JOIN p USING (source, lang, topic))
SELECT *, CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 < probability AS kept FROM x"""


@named("op1_source_mixture", oracle())
def op1_source_mixture(spark, sf_dir):
    return mixed_rows(table(spark, sf_dir, "documents"))
