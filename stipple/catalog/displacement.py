"""Pairs, histograms, decomposition and curve summaries per sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from stipple.catalog.registry import POINTS, R, query, sql_bin
from stipple.functions.columns import finite, rounded
from stipple.operators import curves as cv
from stipple.operators import decompose as dc
from stipple.operators import pairs as pr
from stipple.plans.displacement import cell_curves
from stipple.sources.standins import MAX_UM, N_BINS
from stipple.sources.tables import stored

DIST = "sqrt((a.x_um-b.x_um)*(a.x_um-b.x_um)+(a.y_um-b.y_um)*(a.y_um-b.y_um))"
BIN = sql_bin("d", N_BINS, MAX_UM)
PAIRS = f"""
lag_d AS (SELECT a.sample_id, a.frame, {DIST} AS d FROM points a JOIN points b
          ON a.sample_id = b.sample_id AND a.frame + 1 = b.frame),
same_d AS (SELECT a.sample_id, a.frame, {DIST} AS d FROM points a JOIN points b
           ON a.sample_id = b.sample_id AND a.frame = b.frame),
counts AS (
  SELECT sample_id, 'total' AS component, frame, {BIN} AS bin, count(*) AS n FROM lag_d WHERE d <= 3 GROUP BY ALL
  UNION ALL
  SELECT sample_id, 'background', frame, {BIN}, count(*) FROM same_d WHERE d > 0 AND d <= 3 GROUP BY ALL)
"""


def decomposition_sql(source: str, keys: str, prefix: str = "") -> str:
    """CTEs dense -> fit -> split for counts in ``source`` grouped by ``keys``."""
    k = [c.strip() for c in keys.split(",")]
    on = " AND ".join(f"i.{c} = c.{c}" for c in k)
    ik = ", ".join(f"i.{c}" for c in k)
    fk = ", ".join(f"{c}" for c in k)
    return f"""
{prefix}dense AS (
  SELECT {ik}, g.bin, coalesce(sum(n) FILTER (component = 'total'), 0) AS t,
         coalesce(sum(n) FILTER (component = 'background'), 0) AS b
  FROM (SELECT DISTINCT {fk} FROM {source} WHERE component IN ('total', 'background')) i
  CROSS JOIN (SELECT CAST(r AS INTEGER) AS bin FROM range({N_BINS}) q(r)) g
  LEFT JOIN {source} c ON {on} AND c.bin = g.bin AND c.component IN ('total', 'background') GROUP BY ALL),
{prefix}share AS (
  SELECT *, sum(t) OVER w AS tp, sum(b) OVER w AS bp,
         t / CAST(nullif(sum(t) OVER w, 0) AS DOUBLE) AS total,
         b / CAST(nullif(sum(b) OVER w, 0) AS DOUBLE) AS background
  FROM {prefix}dense WINDOW w AS (PARTITION BY {fk})),
{prefix}fit AS (
  SELECT {fk}, sum(background * total) FILTER (bin >= 21) / nullif(sum(background * background) FILTER (bin >= 21), 0) AS beta_raw
  FROM {prefix}share GROUP BY ALL),
{prefix}split AS (
  SELECT s.*, bin * CAST(0.1 AS DOUBLE) AS left_um, (bin + 1) * CAST(0.1 AS DOUBLE) AS right_um,
         (bin + 0.5) * CAST(0.1 AS DOUBLE) AS mid_um, beta_raw,
         CASE WHEN beta_raw IS NOT NULL THEN greatest(0.0, least(1.0, beta_raw)) END AS beta,
         CASE WHEN beta_raw IS NOT NULL THEN greatest(0.0, least(1.0, beta_raw)) END * background AS inter,
         total - CASE WHEN beta_raw IS NOT NULL THEN greatest(0.0, least(1.0, beta_raw)) END * background AS intra
  FROM {prefix}share s JOIN {prefix}fit f USING ({fk}))
"""


DECOMP = decomposition_sql("counts", "sample_id")
BASE = f"WITH {POINTS}, {PAIRS}, {DECOMP}"


def positive_sql(source: str, keys: str, value: str) -> str:
    """CTE body of the positive-part summary of ``source``."""
    return f"""
pos AS (SELECT {keys}, bin, left_um, right_um, mid_um, greatest({value}, 0.0) AS p FROM {source}),
acc AS (SELECT *, sum(p) OVER (PARTITION BY {keys} ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum,
               sum(p) OVER (PARTITION BY {keys}) * 0.5 AS half FROM pos),
summ AS (
  SELECT {keys}, sum(p) AS positive_mass,
         sum(p * greatest(0.0, least(right_um, CAST(0.3 AS DOUBLE)) - greatest(left_um, 0.0)) / (right_um - left_um)) AS near_mass,
         sum(p * mid_um) AS moment,
         arg_max({{'bin': bin, 'mid': mid_um, 'p': p, 'd': p / (right_um - left_um)}},
                 {{'d': p / (right_um - left_um), 'o': -bin}}) AS top,
         arg_min(left_um + (half - (cum - p)) / nullif(p, 0) * (right_um - left_um), bin) FILTER (half > 0 AND cum >= half) AS med
  FROM acc GROUP BY {keys}),
positive AS (
  SELECT {keys}, CASE WHEN positive_mass > 0 THEN top.bin ELSE -1 END AS peak_bin,
         CASE WHEN positive_mass > 0 THEN top.mid END AS peak_um,
         CASE WHEN positive_mass > 0 THEN top.p END AS peak_mass,
         CASE WHEN positive_mass > 0 THEN top.d END AS peak_density,
         positive_mass, near_mass,
         CASE WHEN positive_mass > 0 THEN moment / positive_mass END AS mean_um,
         CASE WHEN positive_mass > 0 THEN med END AS median_um FROM summ)
"""


POSITIVE_COLUMNS = ("peak_um", "peak_mass", "peak_density", "positive_mass", "near_mass", "mean_um", "median_um")


def round_all(df, *columns):
    return df.withColumns({c: rounded(F.col(c)) for c in columns})


def R_all(*columns):
    return ", ".join(f"{R(c)} AS {c}" for c in columns)


@query(
    "tau1_beta_by_cell",
    "JOIN-1 JOIN-2 AGG-1 AGG-6 AGG-7 CUR-2",
    f"""{BASE} SELECT sample_id, {R('max(beta_raw)')} AS beta_raw, {R('max(beta)')} AS beta,
    max(beta) <> max(beta_raw) AS beta_clipped, max(tp) AS total_pairs, max(bp) AS background_pairs
    FROM split GROUP BY sample_id""",
)
def tau1_beta_by_cell(t):
    c = cell_curves(t.points, max_distance=MAX_UM, n_bins=N_BINS)
    return c.groupBy("sample_id").agg(
        rounded(F.max("beta_raw")).alias("beta_raw"), rounded(F.max("beta")).alias("beta"),
        F.bool_or("beta_clipped").alias("beta_clipped"),
        F.max("total_pairs").alias("total_pairs"), F.max("background_pairs").alias("background_pairs"),
    )


@query(
    "lag_pair_histogram",
    "JOIN-1 AGG-1",
    f"WITH {POINTS}, {PAIRS} SELECT sample_id, bin, CAST(sum(n) AS BIGINT) AS n FROM counts WHERE component = 'total' GROUP BY ALL",
)
def lag_pair_histogram(t):
    c = pr.pair_counts(t.points, max_distance=MAX_UM, n_bins=N_BINS, components=["total"], by_frame=False)
    return c.select("sample_id", "bin", "n")


@query(
    "same_frame_pair_histogram",
    "JOIN-2 AGG-1",
    f"WITH {POINTS}, {PAIRS} SELECT sample_id, bin, CAST(sum(n) AS BIGINT) AS n FROM counts WHERE component = 'background' GROUP BY ALL",
)
def same_frame_pair_histogram(t):
    c = pr.pair_counts(t.points, max_distance=MAX_UM, n_bins=N_BINS, components=["background"], by_frame=False)
    return c.select("sample_id", "bin", "n")


@query(
    "pair_counters",
    "AGG-2",
    f"""WITH {POINTS}, {PAIRS}
    SELECT sample_id, 'total' AS component, count(*) AS candidates, count(DISTINCT frame) AS source_frames,
           count(*) FILTER (d = 0) AS zeros, count(*) FILTER (d <= 3) AS retained FROM lag_d GROUP BY 1
    UNION ALL
    SELECT sample_id, 'background', count(*), count(DISTINCT frame), count(*) FILTER (d = 0),
           count(*) FILTER (d > 0 AND d <= 3) FROM same_d GROUP BY 1""",
)
def pair_counters(t):
    return pr.pair_counters(t.points, max_distance=MAX_UM)


@query(
    "cell_distribution",
    "AGG-8 CUR-1 CUR-14 SNK-1",
    f"""{BASE} SELECT sample_id, bin, {R('left_um')} AS left_um, {R('right_um')} AS right_um,
    {R('total')} AS total, {R('background')} AS background, {R('inter')} AS inter, {R('intra')} AS intra,
    {R('CASE WHEN abs(1 - beta) > 2.220446049250313e-14 THEN intra / (1 - beta) END')} AS intra_conditional,
    {R('total / (right_um - left_um)')} AS total_density, {R('intra / (right_um - left_um)')} AS intra_density,
    {R('CASE WHEN abs(1 - beta) > 2.220446049250313e-14 THEN intra / (1 - beta) END / (right_um - left_um)')} AS intra_conditional_density,
    {R('inter * tp')} AS expected_inter_pairs, {R('intra * tp')} AS expected_intra_pairs
    FROM split""",
)
def cell_distribution(t):
    c = cell_curves(t.points, max_distance=MAX_UM, n_bins=N_BINS)
    c = dc.densities(c, ["total", "intra", "intra_conditional"])
    c = c.withColumn("expected_inter_pairs", F.col("inter") * F.col("total_pairs")).withColumn(
        "expected_intra_pairs", F.col("intra") * F.col("total_pairs")
    )
    values = ["left_um", "right_um", "total", "background", "inter", "intra", "intra_conditional", "total_density",
              "intra_density", "intra_conditional_density", "expected_inter_pairs", "expected_intra_pairs"]
    return stored(round_all(c, *values).select("sample_id", "bin", *values))


@query(
    "cell_quality",
    "AGG-12 SET-8 SNK-3",
    f"""{BASE},
    shp AS (SELECT sample_id, count(*) AS localizations, count(DISTINCT frame) AS frames,
            max(frame) - min(frame) + 1 - count(DISTINCT frame) AS missing_frames,
            count(*) - count(DISTINCT (frame, x_um, y_um)) AS duplicate_rows FROM points GROUP BY 1),
    lc AS (SELECT sample_id, count(*) AS cand, count(*) FILTER (d <= 3) AS kept FROM lag_d GROUP BY 1),
    sc AS (SELECT sample_id, count(*) AS cand, count(*) FILTER (d = 0) AS zeros, count(*) FILTER (d > 0 AND d <= 3) AS kept FROM same_d GROUP BY 1),
    sg AS (SELECT *, sum(t * b) FILTER (bin >= 21) OVER w AS tb, sum(b * b) FILTER (bin >= 21) OVER w AS bb FROM split WINDOW w AS (PARTITION BY sample_id)),
    ft AS (SELECT sample_id, CASE WHEN max(beta_raw) IS NOT NULL THEN bool_or(tb * bp > bb * tp) END AS clipped,
           count(*) FILTER (intra IS NOT NULL AND CASE WHEN tb * bp > bb * tp THEN t * bp < b * tp ELSE t * bb < b * tb END) AS neg,
           -sum(least(intra, 0.0)) AS negmass, max(abs(total - inter - intra)) AS err,
           sum(b) FILTER (bin >= 21) AS tail FROM sg GROUP BY 1)
    SELECT sample_id, localizations, frames, missing_frames, duplicate_rows,
           CAST(neg AS BIGINT) AS negative_intra_bins, {R('negmass')} AS negative_intra_mass,
           greatest(0, zeros - localizations) AS extra_zeros,
           {R('lc.kept / CAST(greatest(lc.cand, 1) AS DOUBLE)')} AS total_retained_fraction,
           {R('sc.kept / CAST(greatest(sc.cand, 1) AS DOUBLE)')} AS background_retained_fraction,
           concat_ws(';', CASE WHEN clipped THEN 'beta_clipped' END, CASE WHEN neg > 0 THEN 'negative_intra_bins' END,
             CASE WHEN missing_frames > 0 THEN 'missing_frames' END,
             CASE WHEN zeros > localizations THEN 'coincident_same_frame_detections_removed' END,
             CASE WHEN tail < 100 THEN 'sparse_inter_tail' END, CASE WHEN err > 1e-12 THEN 'reconstruction_error' END) AS flags,
           CASE WHEN clipped OR neg > 0 OR missing_frames > 0 OR zeros > localizations OR tail < 100 OR err > 1e-12
                THEN 'pass_with_warnings' ELSE 'pass' END AS status
    FROM shp JOIN lc USING (sample_id) JOIN sc USING (sample_id) JOIN ft USING (sample_id)""",
)
def cell_quality(t):
    c = cell_curves(t.points, max_distance=MAX_UM, n_bins=N_BINS)
    q = dc.cell_quality(t.points, pr.candidate_counts(t.points), c, n_bins=N_BINS)
    q = round_all(q, "negative_intra_mass", "total_retained_fraction", "background_retained_fraction")
    return stored(q.select("sample_id", "localizations", "frames", "missing_frames", "duplicate_rows", "negative_intra_bins",
                    "negative_intra_mass", "extra_zeros", "total_retained_fraction", "background_retained_fraction",
                    "flags", "status"))


@query(
    "positive_intra_summary",
    "CUR-6 SRT-2 WIN-2",
    f"{BASE}, {positive_sql('split', 'sample_id', 'intra')} SELECT sample_id, peak_bin, {R_all(*POSITIVE_COLUMNS)} FROM positive",
)
def positive_intra_summary(t):
    c = cell_curves(t.points, max_distance=MAX_UM, n_bins=N_BINS)
    s = cv.positive_summary(c, ["sample_id"], "intra")
    return round_all(s, *POSITIVE_COLUMNS)


@query(
    "position_checks",
    "PRJ-1 PRJ-2 PRJ-3 PRJ-17",
    f"""WITH {POINTS} SELECT sample_id, count(*) AS rows_n,
    count(*) FILTER (isfinite(x_um) AND isfinite(y_um)) AS finite_rows,
    count(*) FILTER (abs(frame * 0.02 / CAST(0.02 AS DOUBLE) - round_even(frame * 0.02 / CAST(0.02 AS DOUBLE), 0)) <= 1e-8) AS on_grid,
    {R('max(abs(x_um - (x_um * 1e3) * 1e-3))')} AS nm_round_trip,
    'UNASSIGNED' AS target FROM points GROUP BY sample_id""",
)
def position_checks(t):
    from stipple.functions.columns import default_text, to_um

    p = t.points.withColumn("steps", F.col("frame") * 0.02 / 0.02)
    back = to_um(F.col("x_um") * 1e3, F.lit("nm"))
    return p.groupBy("sample_id").agg(
        F.count("*").alias("rows_n"),
        F.count_if(finite(F.col("x_um")) & finite(F.col("y_um"))).alias("finite_rows"),
        F.count_if(F.abs(F.col("steps") - F.rint("steps")) <= 1e-8).alias("on_grid"),
        rounded(F.max(F.abs(F.col("x_um") - back))).alias("nm_round_trip"),
        F.max(default_text(F.lit(None))).alias("target"),
    )


@query(
    "frame_step_violations",
    "WIN-1",
    f"""WITH {POINTS}, d AS (SELECT DISTINCT sample_id, frame FROM points),
    s AS (SELECT sample_id, frame - lag(frame) OVER (PARTITION BY sample_id ORDER BY frame) AS step FROM d)
    SELECT sample_id, CAST(step AS INTEGER) AS step, count(*) AS n FROM s WHERE step <> 1 GROUP BY ALL""",
)
def frame_step_violations(t):
    from stipple.operators.points import frame_steps

    return frame_steps(t.points).where("step <> 1").groupBy("sample_id", "step").agg(F.count("*").alias("n"))


@query("point_placement", "PRJ-2",
       f"""WITH {POINTS}, q AS (SELECT sample_id, CASE WHEN photons_e % 7 < 1 THEN NULL ELSE frame END AS frame, CASE WHEN photons_e % 11 < 1 THEN 'NaN'::DOUBLE WHEN photons_e % 13 < 1 THEN NULL ELSE x_um END AS x_um, y_um FROM points)
       SELECT sample_id, count(*) AS points_n, count(*) FILTER (frame IS NOT NULL AND x_um IS NOT NULL AND NOT isnan(x_um)) AS placed,
         count(*) FILTER (frame IS NULL) AS no_frame, count(*) FILTER (x_um IS NULL OR isnan(x_um)) AS no_finite_place FROM q GROUP BY 1""")
def point_placement(t):
    """Points whose frame or place is made unusable by their own values, so that every kind of failure occurs."""
    x = F.when(F.col("photons_e") % 11 < 1, float("nan")).when(F.col("photons_e") % 13 < 1, None).otherwise(F.col("x_um"))
    return pr.placement_report(t.points.withColumns({"frame": F.when(~(F.col("photons_e") % 7 < 1), F.col("frame")), "x_um": x}))


@query("unit_conversion", "PRJ-1",
       f"""WITH {POINTS}, q AS (SELECT ['m', 'um', 'µm', 'nm', 'inch', NULL][CAST(sample_id % 6 AS INTEGER) + 1] AS unit, x_um FROM points),
       s AS (SELECT unit, CASE unit WHEN 'm' THEN x_um / 1000000 WHEN 'nm' THEN x_um * 1000 ELSE x_um END AS saved, x_um FROM q)
       SELECT coalesce(unit, '(none)') AS unit, count(*) AS rows_n, count(*) FILTER (unit IS NULL OR unit = 'inch') AS failures,
         {R("max(CASE WHEN unit <> 'inch' THEN x_um END)", 6)} AS largest_um FROM s GROUP BY unit""")
def unit_conversion(t):
    """Positions saved in metres, micrometres, nanometres, an unknown unit and none, read back as micrometres or failed."""
    from stipple.functions.columns import to_um

    unit = F.get(F.array(*[F.lit(u) for u in ("m", "um", "µm", "nm", "inch")], F.lit(None)), (F.col("sample_id") % 6).cast("int"))
    saved = t.points.select(unit.alias("unit"), F.when(unit == "m", F.col("x_um") / 1e6).when(unit == "nm", F.col("x_um") * 1e3).otherwise(F.col("x_um")).alias("saved"))
    read = to_um(F.col("saved"), F.col("unit"))
    return saved.groupBy("unit").agg(
        F.count("*").alias("rows_n"), F.count_if(read.isNull()).alias("failures"), rounded(F.max(read), 6).alias("largest_um")).withColumn(
        "unit", F.coalesce("unit", F.lit("(none)")))
