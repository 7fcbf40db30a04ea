"""Bootstrap bands, exact tests and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from stipple.catalog import groups as gp
from stipple.catalog.displacement import BASE, decomposition_sql, round_all
from stipple.catalog.registry import CURVES, INVENTORY, METRICS, POINTS, R, query
from stipple.functions import columns as fc
from stipple.functions.columns import rounded
from stipple.operators import decompose as dc
from stipple.operators import inference as nf
from stipple.operators import resample as rs
from stipple.plans.displacement import cell_curves, scoped_curves
from stipple.session import cut_lineage
from stipple.sources.standins import MAX_UM, N_BINS, WIDTH_UM

DRAWS, SEED = 2000, 7
REPLICATES = 2
BDRAWS, LENGTHS, STRATUM = 1000, (10, 25, 50), 250


def hash_sql(*parts: str) -> str:
    text = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5(concat_ws(':', {text})), 1, 8) AS BIGINT)"


@query("cell_bootstrap_bands", "RES-1",
       f"""WITH {CURVES}, c AS (SELECT vec_id AS cell, label AS br, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
       pk AS (SELECT r AS draw, br, {hash_sql(str(SEED), 'r', 'br', 'i - 1')} % n + 1 AS i FROM c CROSS JOIN range({DRAWS}) q(r)),
       w AS (SELECT draw, br, i, count(*) AS w FROM pk GROUP BY ALL), wc AS (SELECT draw, cell, w FROM w JOIN c USING (br, i)),
       d AS (SELECT condition, draw, bin, sum(w * value) / sum(w) AS v FROM curves JOIN wc USING (cell) GROUP BY ALL)
       SELECT condition, bin, count(*) AS draws, {R('quantile_cont(v, 0.025)')} AS p2_5, {R('quantile_cont(v, 0.5)')} AS p50, {R('quantile_cont(v, 0.975)')} AS p97_5 FROM d GROUP BY ALL""")
def cell_bootstrap_bands(t):
    cells = t.raw("embeddings").select(F.col("vec_id").alias("cell"), F.col("label").alias("br"))
    sums = rs.cell_drawn_means(t.curves, cells, group="condition", stratum="br", cell="cell", keys=["bin"], value="value", draws=DRAWS, seed=SEED)
    means = sums.where("weight > 0").select("condition", "bin", "draw", F.when(F.col("valid") > 0, F.col("total") / F.col("weight")).alias("value"))
    return round_all(rs.draw_percentiles(means, ["condition", "bin"], "value"), "p2_5", "p50", "p97_5")


@query("cell_bootstrap_curves", "RES-1",
       f"""{BASE}, {INVENTORY}, cells AS (SELECT DISTINCT sample_id AS cell, br, br || ':' || sample_id % {REPLICATES} AS stratum FROM split JOIN inventory USING (sample_id)),
       c AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY cell) AS i, count(*) OVER (PARTITION BY stratum) AS n, count(*) OVER (PARTITION BY br) AS n_cells FROM cells),
       pk AS (SELECT r AS draw, stratum, {hash_sql(str(SEED), 'r', 'stratum', 'i - 1')} % n + 1 AS i FROM c CROSS JOIN range({DRAWS}) q(r)),
       wc AS (SELECT draw, br, cell, count(*) AS w FROM pk JOIN c USING (stratum, i) GROUP BY ALL),
       v AS (SELECT sample_id AS cell, bin, unnest(['total', 'inter', 'intra']) AS name, unnest([total, inter, intra]) AS value FROM split
         UNION ALL SELECT sample_id, NULL, 'beta', max(beta) FROM split GROUP BY 1),
       d AS (SELECT br, name, bin, draw, sum(w * value) / sum(w) FILTER (value IS NOT NULL) AS m FROM wc JOIN v USING (cell) GROUP BY ALL),
       k AS (SELECT DISTINCT br, n_cells, name, bin FROM c JOIN v USING (cell)),
       q AS (SELECT br, name, bin, count(m) AS draws, {", ".join(R(f'quantile_cont(m, {p})') + f" AS {n}" for n, p in (("p2_5", 0.025), ("p50", 0.5), ("p97_5", 0.975)))} FROM d GROUP BY ALL)
       SELECT k.br, k.n_cells, CASE WHEN n_cells < 2 THEN 'single_cell_no_interval' ELSE 'cell_bootstrap' END AS status, k.name, k.bin, CASE WHEN n_cells < 2 THEN 0 ELSE draws END AS draws,
         {", ".join(f"CASE WHEN n_cells >= 2 THEN {n} END AS {n}" for n in ("p2_5", "p50", "p97_5"))}
       FROM k JOIN q ON k.br = q.br AND k.name = q.name AND k.bin IS NOT DISTINCT FROM q.bin""")
def cell_bootstrap_curves(t):
    """Total, inter and intra curves and the background mass of every group from one set of draws, cells drawn within their replicate."""
    curves = cell_curves(t.points, max_distance=MAX_UM, n_bins=N_BINS).join(t.inventory.select("sample_id", "br"), "sample_id")
    curves = cut_lineage(curves.select("br", F.col("sample_id").alias("cell"), "bin", "total", "inter", "intra", "beta"))
    stratum = F.concat_ws(":", "br", F.col("cell") % REPLICATES).alias("stratum")
    cells = cut_lineage(curves.select("br", "cell", stratum).distinct())
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("total", "inter", "intra")])
    beta = curves.groupBy("br", "cell").agg(F.max("beta").alias("value")).select("br", "cell", F.lit("beta").alias("name"), F.lit(None).cast("int").alias("bin"), "value")
    long = curves.select("br", "cell", "bin", F.inline(each)).select("br", "cell", "name", "bin", "value").unionByName(beta)
    sums = rs.cell_drawn_means(long, cells, group="br", stratum="stratum", cell="cell", keys=["name", "bin"], value="value", draws=DRAWS, seed=SEED)
    means = sums.withColumn("m", F.when(F.col("valid") > 0, F.col("total") / F.col("valid")))
    out = rs.draw_percentiles(means, ["br", "name", "bin"], "m").join(cells.groupBy("br").agg(F.count("*").alias("n_cells")), "br")
    many = F.col("n_cells") >= 2
    told = {n: F.when(many, F.col(n)) for n in ("p2_5", "p50", "p97_5")}
    status = F.when(many, "cell_bootstrap").otherwise("single_cell_no_interval").alias("status")
    return round_all(out.select("br", "n_cells", status, "name", "bin", F.when(many, F.col("draws")).otherwise(0).cast("long").alias("draws"),
                                *[c.alias(n) for n, c in told.items()]), *told)


PLAN = f"""bl AS (SELECT CAST(length AS INTEGER) AS length FROM (VALUES (10), (25), (50)) l(length)),
st AS (SELECT length, r AS stratum, CAST(ceil(least(hi + 1 - r * {STRATUM}, {STRATUM}) / CAST(length AS DOUBLE)) AS BIGINT) AS blocks
   FROM bl, (SELECT max(frame) AS hi, unnest(range(max(frame) // {STRATUM} + 1)) AS r FROM movies) s),
pl AS (SELECT length, d.r AS draw, stratum, CAST(stratum * ({STRATUM} // length) + {hash_sql(str(SEED), 'length', 'd.r', 'stratum', 'k.r')} % blocks AS INTEGER) AS block
   FROM st, range({BDRAWS}) d(r), range(25) k(r) WHERE k.r < blocks),
plan AS (SELECT length, CAST(draw AS INTEGER) AS draw, CAST(stratum AS INTEGER) AS stratum, block, count(*) AS w FROM pl GROUP BY ALL)"""
INSIDE = "component IN ('total', 'background') AND (component <> 'total' OR frame % length <> length - 1)"


def last_frame(t):
    return t.movies.select(F.max("frame"))


def shared(t):
    return {"last_frame": last_frame(t).scalar(), "stratum_frames": STRATUM, "lengths": LENGTHS, "draws": BDRAWS, "seed": SEED}


def all_block_sums(counts):
    """Per-block counts for every block length, the lengths side by side."""
    units = None
    for length in LENGTHS:
        b = rs.block_sums(counts, length=length).withColumn("length", F.lit(length))
        units = b if units is None else units.unionByName(b)
    return units


@query("block_plan_pair_totals", "RES-2 RES-3",
       f"""{gp.G}, {PLAN}, b AS (SELECT length, component, frame // length AS block, sum(n) AS n FROM gcounts CROSS JOIN bl WHERE {INSIDE} GROUP BY ALL)
       SELECT length, draw, component, CAST(sum(w * n) AS BIGINT) AS n FROM b JOIN plan USING (length, block) GROUP BY ALL""")
def block_plan_pair_totals(t):
    # the frame dimension is summed once per block length, then meets the shared weights
    per_frame = gp.movie_counts(t).where("component in ('total', 'background')").groupBy("component", "frame").agg(F.sum("n").alias("n"))
    per_frame = cut_lineage(per_frame)  # a few rows per frame, used once per block length
    plan = rs.block_plan(t.spark, **shared(t))
    return all_block_sums(per_frame).join(plan, ["length", "block"]).groupBy("length", "draw", "component").agg(F.sum(F.col("w") * F.col("n")).alias("n"))


@query("resampling_units", "RES-3",
       f"""WITH {POINTS}, f AS (SELECT length, CAST(unnest(range(hi + 1)) AS INTEGER) AS source_frame FROM (VALUES (10), (25), (50)) l(length), (SELECT max(frame) AS hi FROM movies))
       SELECT CAST(length AS INTEGER) AS length, source_frame, CAST(source_frame + 1 AS INTEGER) AS target_frame, CAST(source_frame // length AS INTEGER) AS block, CAST(source_frame // {STRATUM} AS INTEGER) AS stratum,
         source_frame IN (SELECT frame FROM movies) AND source_frame + 1 IN (SELECT frame FROM movies) AS endpoint_valid
       FROM f WHERE source_frame % length < length - 1 AND source_frame < (SELECT max(frame) FROM movies)""")
def resampling_units(t):
    """True internal pairs of every block length, and whether both their frames have points."""
    frames = t.movies.select("frame").distinct()
    units = None
    for length in LENGTHS:
        u = rs.unit_pairs(last_frame(t), length=length, stratum_frames=STRATUM).withColumn("length", F.lit(length))
        units = u if units is None else units.unionByName(u)
    there = lambda c: frames.select(F.col("frame").alias(c), F.lit(True).alias(f"{c}_there"))
    units = units.join(there("source_frame"), "source_frame", "left").join(there("target_frame"), "target_frame", "left")
    valid = F.coalesce(F.col("source_frame_there") & F.col("target_frame_there"), F.lit(False))
    return units.select("length", "source_frame", "target_frame", "block", "stratum", valid.alias("endpoint_valid"))


def saved_counts(t):
    """Per-frame counts written once: the sufficient statistic that draws and point estimates share."""
    return cut_lineage(gp.movie_counts(t).where("component in ('total', 'background')"))


DKEYS = ["sample_id", "grp", "length", "scope"]
PKEYS = ["sample_id", "grp", "scope"]


def draw_splits(t, counts):
    drawn = rs.drawn_counts(all_block_sums(counts), rs.block_picks(t.spark, **shared(t)), ["sample_id", "grp"], stratum_frames=STRATUM)
    return rs.drawn_splits(drawn, DKEYS, n_bins=N_BINS, width=WIDTH_UM)


def observed_curves(t, counts):
    return scoped_curves(counts, rs.stratum_scopes(last_frame(t), STRATUM), max_distance=MAX_UM, n_bins=N_BINS)


def observed_metrics(t, counts):
    s = dc.guarded_summary(observed_curves(t, counts), PKEYS, n_bins=N_BINS, width=WIDTH_UM)
    return s.unpivot(PKEYS, list(rs.METRIC_NAMES), "metric", "point")


SCOPES = f"""scopes AS (SELECT 'full' AS scope, 0 AS start, max(frame) + 1 AS stop FROM movies
  UNION ALL SELECT 's' || k, k * {STRATUM}, least(hi + 1, (k + 1) * {STRATUM}) FROM (SELECT max(frame) AS hi, unnest(range(max(frame) // {STRATUM} + 1)) AS k FROM movies))"""
DRAWN = f"""bs AS (SELECT length, sample_id, grp, component, frame // length AS block, bin, sum(n) AS n FROM gcounts CROSS JOIN bl WHERE {INSIDE} GROUP BY ALL),
  dw AS (SELECT sample_id, grp, length, stratum, component, bin, draw, sum(w * n) AS n FROM bs JOIN plan USING (length, block) GROUP BY ALL),
  dcnt AS (SELECT sample_id, grp, length, 's' || stratum AS scope, draw, component, bin, n FROM dw
    UNION ALL SELECT sample_id, grp, length, 'full', draw, component, bin, sum(n) FROM dw GROUP BY ALL)"""
BOOT = f"""{gp.G}, {PLAN}, {DRAWN}, {decomposition_sql('dcnt', 'sample_id, grp, length, scope, draw', 'd_')},
  {SCOPES}, {gp.scoped_sql()}, {gp.GUARD},
  dsum AS (SELECT sample_id, grp, length, scope, draw, max(tp) AS tp, max(bp) AS bp, sum(t) FILTER (bin >= 21) >= 100 AND sum(b) FILTER (bin >= 21) >= 100 AS ok, max(beta) AS beta0,
     sum(intra) AS area0, sum(intra) FILTER (mid_um < CAST(0.1 AS DOUBLE)) AS main0, sum(intra) FILTER (mid_um >= CAST(0.1 AS DOUBLE) AND mid_um < 0.25) AS tail0 FROM d_split GROUP BY ALL),
  dval AS (SELECT *, CASE WHEN ok THEN beta0 END AS beta, CASE WHEN ok THEN area0 END AS signed_area, CASE WHEN ok THEN main0 END AS main_mass, CASE WHEN ok THEN tail0 END AS tail_mass,
     CASE WHEN ok AND main0 > 0.01 THEN tail0 / main0 END AS tail_main_ratio FROM dsum),
  dmet AS (SELECT sample_id, grp, length, scope, draw, unnest(['beta', 'signed_area', 'main_mass', 'tail_mass', 'tail_main_ratio']) AS metric, unnest([beta, signed_area, main_mass, tail_mass, tail_main_ratio]) AS value FROM dval),
  pmet AS (SELECT sample_id, grp, scope, unnest(['beta', 'signed_area', 'main_mass', 'tail_mass', 'tail_main_ratio']) AS metric, unnest([beta, signed_area, main_mass, tail_mass, tail_main_ratio]) AS point FROM summary)"""


def within_sql(value: str, p: float, point: str) -> str:
    return R(f"CASE WHEN count({value}) >= {0.95 * BDRAWS} AND any_value({point}) IS NOT NULL THEN quantile_cont({value}, {p}) END")


@query("block_bootstrap_intervals", "RES-4 RES-5",
       f"""{BOOT} SELECT sample_id, grp, length, scope, metric, count(value) AS valid_draws, {R(f'count(value) / {float(BDRAWS)}')} AS valid_fraction, {R('any_value(point)')} AS point,
         {within_sql('value', 0.025, 'point')} AS low, {within_sql('value', 0.975, 'point')} AS high FROM dmet LEFT JOIN pmet USING (sample_id, grp, scope, metric) GROUP BY ALL""")
def block_bootstrap_intervals(t):
    """Every block length, scope and group, five metrics."""
    counts = saved_counts(t)
    rows = rs.drawn_metrics(draw_splits(t, counts), DKEYS).select(*DKEYS, "metric", rs.array_interval(F.col("values"), BDRAWS).alias("i"))
    out = rows.select(*DKEYS, "metric", "i.*").join(observed_metrics(t, counts), [*PKEYS, "metric"], "left")
    has = F.col("point").isNotNull()
    out = out.withColumns({"low": F.when(has, F.col("low")), "high": F.when(has, F.col("high"))})
    return round_all(out, "valid_fraction", "point", "low", "high")


FIELD_SQL = f"""dfld AS (SELECT s.sample_id, s.grp, s.length, s.scope, s.draw, s.bin, unnest(['total', 'background', 'inter', 'intra', 'shape']) AS field,
    unnest([total / {WIDTH_UM}, background / {WIDTH_UM}, CASE WHEN ok THEN inter / {WIDTH_UM} END, CASE WHEN ok THEN intra / {WIDTH_UM} END, CASE WHEN ok AND abs(area0) > 0.01 THEN intra / area0 / {WIDTH_UM} END]) AS value
    FROM d_split s JOIN dval USING (sample_id, grp, length, scope, draw)),
  pfld AS (SELECT s.sample_id, s.grp, s.scope, s.bin, unnest(['total', 'background', 'inter', 'intra', 'shape']) AS field,
    unnest([total / {WIDTH_UM}, background / {WIDTH_UM}, CASE WHEN tail_supported THEN inter / {WIDTH_UM} END, CASE WHEN tail_supported THEN intra / {WIDTH_UM} END, CASE WHEN u.status = 'available_shape' THEN intra / u.signed_area / {WIDTH_UM} END]) AS point
    FROM split s JOIN summary u USING (sample_id, grp, scope)),
  pf AS (SELECT a.sample_id, a.scope, a.bin, a.field, a.point - b.point AS point FROM pfld a JOIN pfld b USING (sample_id, scope, bin, field) WHERE a.grp = 'On' AND b.grp = 'Not-on')"""


@query("paired_curve_bands", "RES-6",
       f"""{BOOT}, {FIELD_SQL}, d AS (SELECT sample_id, length, scope, bin, field, a.value AS va, b.value AS vb FROM dfld a JOIN dfld b USING (sample_id, length, scope, draw, bin, field)
          WHERE a.grp = 'On' AND b.grp = 'Not-on' AND a.value IS NOT NULL AND b.value IS NOT NULL),
       e AS (SELECT sample_id, length, scope, bin, field, count(*) AS common_draws, {", ".join(f"quantile_cont({v}, {p}) AS {n}_{e}" for v, n in (("va", "on"), ("vb", "not_on"), ("va - vb", "difference")) for e, p in (("low", 0.025), ("high", 0.975)))} FROM d GROUP BY ALL)
       SELECT k.sample_id, k.length, k.scope, k.bin, k.field, coalesce(common_draws, 0) AS common_draws, {R('point')} AS point_difference,
         {", ".join(R(f"CASE WHEN common_draws >= {0.95 * BDRAWS} AND point IS NOT NULL THEN {n}_{e} END") + f" AS {n}_{e}" for n in ("on", "not_on", "difference") for e in ("low", "high"))}
       FROM (SELECT DISTINCT a.sample_id, a.length, a.scope, a.bin, a.field FROM dfld a JOIN dfld b USING (sample_id, length, scope, draw, bin, field) WHERE a.draw = 0 AND a.grp = 'On' AND b.grp = 'Not-on') k
       LEFT JOIN e USING (sample_id, length, scope, bin, field) LEFT JOIN pf USING (sample_id, scope, bin, field)""")
def paired_curve_bands(t):
    """Bands of both groups and of their difference over the draws valid in both, for every field, length and scope."""
    counts = saved_counts(t)
    keys = ["sample_id", "length", "scope", "bin", "field"]
    pairs = rs.paired_draws(rs.drawn_fields(draw_splits(t, counts), DKEYS, WIDTH_UM), keys)
    parts = {"on": lambda z: z["a"], "not_on": lambda z: z["b"], "difference": lambda z: z["a"] - z["b"]}
    rows = pairs.select(*keys, F.size("pairs").cast("long").alias("common_draws"),
                        *[rs.array_interval(F.transform("pairs", f), BDRAWS).alias(n) for n, f in parts.items()])
    curves = dc.with_shape(observed_curves(t, counts), PKEYS, n_bins=N_BINS).join(
        dc.guarded_summary(observed_curves(t, counts), PKEYS, n_bins=N_BINS, width=WIDTH_UM).select(*PKEYS, "tail_supported"), PKEYS)
    fitted = lambda c: F.when(F.col("tail_supported"), F.col(c))
    fields = {"total": F.col("total"), "background": F.col("background"), "inter": fitted("inter"), "intra": fitted("intra"), "shape": F.col("shape")}
    long = curves.select(*PKEYS, "bin", F.inline(F.array(*[F.struct(F.lit(n).alias("field"), (c / WIDTH_UM).alias("v")) for n, c in fields.items()])))
    side = lambda g: F.max(F.when(F.col("grp") == g, F.col("v")))
    points = long.groupBy("sample_id", "scope", "bin", "field").agg((side("On") - side("Not-on")).alias("point_difference"))
    out = rows.join(points, ["sample_id", "scope", "bin", "field"], "left")
    has = F.col("point_difference").isNotNull()
    ends = {f"{n}_{e}": F.when(has, F.col(n)[e]) for n in parts for e in ("low", "high")}
    return round_all(out.select(*keys, "common_draws", "point_difference", *[c.alias(n) for n, c in ends.items()]), "point_difference", *ends)


@query("paired_scalar_differences", "RES-7",
       f"""{BOOT}, d AS (SELECT sample_id, length, scope, metric, CASE WHEN a.value IS NOT NULL AND b.value IS NOT NULL THEN a.value - b.value END AS difference FROM dmet a JOIN dmet b USING (sample_id, length, scope, draw, metric) WHERE a.grp = 'On' AND b.grp = 'Not-on'),
       p AS (SELECT a.sample_id, a.scope, a.metric, a.point - b.point AS point_difference FROM pmet a JOIN pmet b USING (sample_id, scope, metric) WHERE a.grp = 'On' AND b.grp = 'Not-on')
       SELECT sample_id, length, scope, metric, {R('any_value(point_difference)')} AS point_difference, count(difference) AS valid_draws, {R(f'count(difference) / {float(BDRAWS)}')} AS valid_fraction,
         {within_sql('difference', 0.025, 'point_difference')} AS low, {within_sql('difference', 0.975, 'point_difference')} AS high FROM d LEFT JOIN p USING (sample_id, scope, metric) GROUP BY ALL""")
def paired_scalar_differences(t):
    counts = saved_counts(t)
    keys = ["sample_id", "length", "scope", "metric"]
    pairs = rs.paired_draws(rs.drawn_metrics(draw_splits(t, counts), DKEYS), keys)
    rows = pairs.select(*keys, rs.array_interval(F.transform("pairs", lambda z: z["a"] - z["b"]), BDRAWS).alias("i")).select(*keys, "i.*")
    side = lambda g: F.max(F.when(F.col("grp") == g, F.col("point")))
    points = observed_metrics(t, counts).groupBy("sample_id", "scope", "metric").agg((side("On") - side("Not-on")).alias("point_difference"))
    out = rows.join(points, ["sample_id", "scope", "metric"], "left")
    has = F.col("point_difference").isNotNull()
    out = out.withColumns({"low": F.when(has, F.col("low")), "high": F.when(has, F.col("high"))})
    return round_all(out, "valid_fraction", "point_difference", "low", "high")


@query("block_boundary_control", "RES-8",
       f"""{gp.G}, bl AS (SELECT CAST(length AS INTEGER) AS length FROM (VALUES (10), (25), (50)) l(length)), {SCOPES},
       u AS (SELECT sample_id, grp, length, scope, component, bin, sum(n) AS n FROM gcounts JOIN scopes ON frame >= start AND frame < stop CROSS JOIN bl WHERE {INSIDE} GROUP BY ALL),
       {gp.scoped_sql()}, {decomposition_sql('u', 'sample_id, grp, length, scope', 'u_')},
       a AS (SELECT sample_id, grp, length, scope, max(beta) AS beta, max(tp) AS n FROM u_split GROUP BY ALL), b AS (SELECT sample_id, grp, scope, max(beta) AS beta, max(tp) AS n FROM split GROUP BY ALL),
       c AS (SELECT x.sample_id, x.grp, x.length, x.scope, max(abs(x.intra - y.intra)) AS change, sum(x.intra) - sum(y.intra) AS area FROM u_split x JOIN split y USING (sample_id, grp, scope, bin) GROUP BY ALL)
       SELECT sample_id, grp, length, scope, CAST(a.n AS BIGINT) AS block_pairs, CAST(b.n AS BIGINT) AS all_pairs, {R('a.beta - b.beta')} AS beta_change, {R('area')} AS signed_area_change, {R('change')} AS max_intra_change
       FROM a JOIN b USING (sample_id, grp, scope) JOIN c USING (sample_id, grp, length, scope)""")
def block_boundary_control(t):
    """Curves from the pairs inside blocks against those from all pairs, for every length and scope."""
    counts = saved_counts(t)
    scopes = rs.stratum_scopes(last_frame(t), STRATUM)
    inside = None
    for length in LENGTHS:
        own = counts.where((F.col("component") != "total") | (F.col("frame") % length != length - 1)).withColumn("length", F.lit(length))
        inside = own if inside is None else inside.unionByName(own)
    at = (F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("stop"))
    pooled = inside.join(F.broadcast(scopes) if rs.small_enough(scopes) else scopes, at).groupBy(*DKEYS, "component", "bin").agg(F.sum("n").alias("n"))
    block = dc.decompose(dc.dense_curves(pooled, DKEYS, n_bins=N_BINS, width=WIDTH_UM), DKEYS, n_bins=N_BINS)
    whole = observed_curves(t, counts).select(*PKEYS, "bin", F.col("intra").alias("intra0"), F.col("beta").alias("beta0"), F.col("total_pairs").alias("all_pairs"))
    out = block.join(whole, [*PKEYS, "bin"]).groupBy(*DKEYS).agg(
        F.max("total_pairs").alias("block_pairs"), F.max("all_pairs").alias("all_pairs"), (F.max("beta") - F.max("beta0")).alias("beta_change"),
        (F.sum("intra") - F.sum("intra0")).alias("signed_area_change"), F.max(F.abs(F.col("intra") - F.col("intra0"))).alias("max_intra_change"))
    return round_all(out, "beta_change", "signed_area_change", "max_intra_change")


MEANS = f"""WITH {METRICS}, l AS (SELECT protein, condition, br, endpoint, value FROM (SELECT protein, condition, br, 'on_pct' AS endpoint, on_pct AS value FROM cell_metrics
   UNION ALL SELECT protein, condition, br, 'area', area FROM cell_metrics)),
m AS (SELECT endpoint, protein, condition, br, avg(value) AS mean, count(value) AS n FROM l GROUP BY ALL),
ls AS (SELECT endpoint, protein, condition, list(mean ORDER BY br) AS v, sum(n) AS n_cells FROM m WHERE mean IS NOT NULL GROUP BY ALL),
cmp AS (SELECT a.endpoint, a.protein AS pa, a.condition AS ca, b.protein AS pb, b.condition AS cb, a.v AS va, b.v AS vb, a.n_cells AS na_cells, b.n_cells AS nb_cells,
   CASE WHEN a.condition = b.condition THEN 'proteins_within_condition' ELSE 'conditions_within_protein' END AS kind,
   a.endpoint || ':' || a.protein || '_' || a.condition || '_minus_' || b.protein || '_' || b.condition AS comparison_id
   FROM ls a JOIN ls b ON a.endpoint = b.endpoint AND ((a.condition = b.condition AND a.protein < b.protein) OR (a.protein = b.protein AND a.condition < b.condition)))
"""
PERM = """
vv AS (SELECT comparison_id, len(va) AS na, len(vb) AS nb, list_transform(list_concat(va, vb), lambda x: CAST(round(x, 9) AS DECIMAL(28, 9))) AS v FROM cmp),
ms AS (SELECT comparison_id, na, nb, v, r AS mask FROM vv, range(1024) q(r) WHERE bit_count(r) = na AND r < (1 << (na + nb))),
sm AS (SELECT comparison_id, mask, any_value(na) AS na, any_value(nb) AS nb, sum(val) AS total, sum(val) FILTER ((mask >> (i - 1)) & 1 = 1) AS lsum, sum(val) FILTER (i <= na) AS osum
   FROM (SELECT comparison_id, mask, na, nb, unnest(v) AS val, generate_subscripts(v, 1) AS i FROM ms) GROUP BY comparison_id, mask),
ef AS (SELECT *, CAST(lsum AS DOUBLE) / na - CAST(total - lsum AS DOUBLE) / nb AS x, CAST(osum AS DOUBLE) / na - CAST(total - osum AS DOUBLE) / nb AS obs FROM sm),
perm AS (SELECT comparison_id, max(obs) AS difference, count(*) AS partitions,
   least(1.0, 2.0 * least(count(*) FILTER (x <= obs + 2.220446049250313e-14 * greatest(abs(obs), 1.0) OR lsum = osum), count(*) FILTER (x >= obs - 2.220446049250313e-14 * greatest(abs(obs), 1.0) OR lsum = osum)) / CAST(count(*) AS DOUBLE)) AS p_raw
   FROM ef GROUP BY comparison_id)
"""


def comparisons(t):
    long = t.cell_metrics.unpivot(["protein", "condition", "br"], ["on_pct", "area"], "endpoint", "value")
    means = long.groupBy("endpoint", "protein", "condition", "br").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return nf.planned_comparisons(means)


@query("planned_comparisons", "RES-10", f"{MEANS} SELECT comparison_id, endpoint, kind, len(va) AS n_br_a, len(vb) AS n_br_b, CAST(na_cells AS BIGINT) AS n_cells_a, CAST(nb_cells AS BIGINT) AS n_cells_b FROM cmp")
def planned_comparisons(t):
    return comparisons(t).select("comparison_id", "endpoint", "kind", F.size("values_a").alias("n_br_a"), F.size("values_b").alias("n_br_b"), "n_cells_a", "n_cells_b")


@query("exact_permutation_tests", "RES-9 RES-11 WIN-6",
       f"""{MEANS}, {PERM}, k AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p_raw, comparison_id) + 1) * p_raw) AS s FROM perm)
       SELECT comparison_id, {R('difference', 5)} AS difference, partitions, {R('p_raw')} AS p_raw, {R('max(s) OVER (ORDER BY p_raw, comparison_id ROWS UNBOUNDED PRECEDING)')} AS p_holm FROM k""")
def exact_permutation_tests(t):
    h = nf.holm(nf.exact_permutation(comparisons(t)))
    return h.select("comparison_id", rounded(F.col("difference"), 5).alias("difference"), "partitions", rounded(F.col("p_raw")).alias("p_raw"), rounded(F.col("p_holm")).alias("p_holm"))


@query("effect_sizes", "RES-12",
       f"""{MEANS}, e AS (SELECT comparison_id, list_avg(va) AS a, list_avg(vb) AS b FROM cmp)
       SELECT comparison_id, {R('a', 5)} AS mean_a, {R('b', 5)} AS mean_b, {R('a - b', 5)} AS effect, {R('100.0 * (a - b) / b', 6)} AS relative_pct, {R('a / b')} AS mean_ratio, abs(a / b - (1 + (100.0 * (a - b) / b) / 100)) <= CAST(1e-12 AS DOUBLE) * greatest(1.0, abs(a / b)) AS consistent FROM e""")
def effect_sizes(t):
    e = nf.effect_sizes(comparisons(t))
    return e.select("comparison_id", *[rounded(F.col(c), 5).alias(c) for c in ("mean_a", "mean_b", "effect")],
                    rounded(F.col("relative_pct"), 6).alias("relative_pct"), rounded(F.col("mean_ratio")).alias("mean_ratio"), "consistent")


def _poly(c, x, tail=False):
    out = f"CAST('{c[0]!r}' AS DOUBLE)"
    for v in c[1:]:
        out = f"({out} * {x} + CAST('{v!r}' AS DOUBLE))"
    return f"({out} * {x} + 1.0)" if tail else out


def icdf_sql(p: str) -> str:
    q, lo, hi = f"({p} - 0.5)", f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - {p}))"
    qq = f"({q} * {q})"
    return (f"CASE WHEN {p} < 0.02425 THEN {_poly(fc._ICDF_C, lo)} / {_poly(fc._ICDF_D, lo, True)} "
            f"WHEN {p} > 1 - 0.02425 THEN -{_poly(fc._ICDF_C, hi)} / {_poly(fc._ICDF_D, hi, True)} "
            f"ELSE {q} * {_poly(fc._ICDF_A, qq)} / {_poly(fc._ICDF_B, qq, True)} END")


@query("normality_diagnostics", "RES-13 WIN-12",
       f"""WITH {METRICS}, r AS (SELECT protein, condition, on_pct AS v, row_number() OVER (PARTITION BY protein, condition ORDER BY on_pct, cell) AS i, CAST(count(*) OVER (PARTITION BY protein, condition) AS DOUBLE) AS n FROM cell_metrics WHERE on_pct IS NOT NULL),
       f AS (SELECT *, CASE WHEN i = 1 THEN 1 - power(0.5, 1.0 / n) WHEN i = n THEN power(0.5, 1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END AS p FROM r),
       z AS (SELECT *, {icdf_sql('p')} AS z FROM f)
       SELECT protein, condition, count(*) AS n, {R('avg(v)')} AS mean, {R('stddev_samp(v)')} AS sd, {R('skewness(v)', 7)} AS skewness, {R('regr_slope(v, z)', 7)} AS qq_slope, {R('regr_intercept(v, z)', 7)} AS qq_intercept, {R('corr(v, z)')} AS qq_r
       FROM z GROUP BY ALL""")
def normality_diagnostics(t):
    n = nf.normality(t.cell_metrics, ["protein", "condition"], "on_pct", order=["cell"])
    n = round_all(n, "mean", "sd", "qq_r")
    return n.withColumns({c: rounded(F.col(c), 7) for c in ("skewness", "qq_slope", "qq_intercept")})


@query("cohort_guard_report", "AGG-56",
       f"""WITH {METRICS}, o AS (SELECT count(*) AS cells, count(*) FILTER (roi_candidates IS NULL) AS a, count(*) FILTER (on_pct IS NULL) AS b, count(*) FILTER (area IS NULL) AS c FROM cell_metrics)
       SELECT cells, "check", failures, failures = 0 AS ok FROM (SELECT cells, unnest(['counts_conserved', 'valid_on_pct', 'valid_area']) AS "check", unnest([a, b, c]) AS failures FROM o)""")
def cohort_guard_report(t):
    return nf.guard_report(t.cell_metrics, ["on_pct", "area"])
