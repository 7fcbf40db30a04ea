"""Grouped pair counts, scoped decompositions, label attachment and label counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stipple.catalog.displacement import BIN, DIST, R_all, decomposition_sql, round_all
from stipple.catalog.registry import LABELINGS, POINTS, R, query
from stipple.functions.columns import rounded, strict_bool
from stipple.operators import checks as ck
from stipple.operators import curves as cv
from stipple.operators import decompose as dc
from stipple.operators import labels as lb
from stipple.operators import pairs as pr
from stipple.operators import points as pt
from stipple.operators.skew import exact_quantiles
from stipple.plans.displacement import scoped_curves
from stipple.sources.standins import FRAME_S, MAX_UM, N_BINS, WIDTH_UM

WINDOWS = 10  # equal parts of the movie beside the full scope
SCOPE_SQL = f"""span AS (SELECT min(frame) AS lo, max(frame) + 1 AS hi, CAST(ceil((max(frame) + 1 - min(frame)) / CAST({WINDOWS} AS DOUBLE)) AS INTEGER) AS step FROM movies),
scopes AS (SELECT 'full' AS scope, lo AS start, hi AS stop FROM span
  UNION ALL SELECT 'w' || k, lo + k * step, least(hi, lo + (k + 1) * step) FROM span, range({WINDOWS}) q(k) WHERE lo + k * step < hi)"""
KEYS = ["sample_id", "grp", "scope"]


def gcounts_sql(source: str = "movies", out: str = "gcounts", where: str = "grp IN ('On', 'Not-on')") -> str:
    return f"""
{out}_p AS (SELECT sample_id, frame, x_um, y_um, grp FROM {source} WHERE {where}),
{out}_lag AS (SELECT a.sample_id, a.frame, a.grp AS ga, b.grp AS gb, {DIST} AS d FROM {out}_p a JOIN {out}_p b
         ON a.sample_id = b.sample_id AND a.frame + 1 = b.frame),
{out}_same AS (SELECT a.sample_id, a.frame, a.grp AS ga, b.grp AS gb, {DIST} AS d FROM {out}_p a JOIN {out}_p b
          ON a.sample_id = b.sample_id AND a.frame = b.frame),
{out} AS (
  SELECT sample_id, CASE WHEN ga = gb THEN 'total' ELSE 'cross' END AS component, ga AS grp, frame, {BIN} AS bin, count(*) AS n
  FROM {out}_lag WHERE d <= 3 GROUP BY ALL
  UNION ALL
  SELECT sample_id, CASE WHEN ga = gb THEN 'background' ELSE 'same_cross_background' END, ga, frame, {BIN},
         count(*) * any_value(CASE WHEN ga = gb THEN 1 ELSE 2 END)
  FROM {out}_same WHERE d > 0 AND d <= 3 AND (ga = gb OR ga = 'On') GROUP BY sample_id, 2, ga, frame, 5)"""


def scoped_sql(counts: str = "gcounts", prefix: str = "") -> str:
    return f"""
{prefix}pool AS (SELECT sample_id, grp, scope, component, bin, sum(n) AS n FROM {counts} JOIN scopes
  ON frame >= start AND frame < stop AND (component NOT IN ('total', 'cross') OR frame < stop - 1) GROUP BY ALL),
{decomposition_sql(prefix + 'pool', 'sample_id, grp, scope', prefix)}"""


G = f"WITH {POINTS}, {gcounts_sql()}"
S = f"{G}, {SCOPE_SQL}, {scoped_sql()}"
GUARD = """
gsum AS (SELECT sample_id, grp, scope, max(tp) AS total_pairs, max(bp) AS background_pairs,
  sum(t) FILTER (bin >= 21) AS total_tail_pairs, sum(b) FILTER (bin >= 21) AS background_tail_pairs,
  max(beta_raw) AS br0, max(beta) AS b0, sum(intra) AS a0,
  sum(intra) FILTER (mid_um < CAST(0.1 AS DOUBLE)) AS m0,
  sum(intra) FILTER (mid_um >= CAST(0.1 AS DOUBLE) AND mid_um < 0.25) AS t0, -sum(least(intra, 0.0)) AS n0 FROM split GROUP BY ALL),
guarded AS (SELECT *, total_tail_pairs >= 100 AND background_tail_pairs >= 100 AS tail_supported,
  CASE WHEN total_tail_pairs >= 100 AND background_tail_pairs >= 100 THEN br0 END AS beta_raw,
  CASE WHEN total_tail_pairs >= 100 AND background_tail_pairs >= 100 THEN b0 END AS beta,
  CASE WHEN total_tail_pairs >= 100 AND background_tail_pairs >= 100 THEN a0 END AS signed_area,
  CASE WHEN total_tail_pairs >= 100 AND background_tail_pairs >= 100 THEN m0 END AS main_mass,
  CASE WHEN total_tail_pairs >= 100 AND background_tail_pairs >= 100 THEN t0 END AS tail_mass,
  CASE WHEN total_tail_pairs >= 100 AND background_tail_pairs >= 100 THEN n0 END AS negative_mass FROM gsum),
summary AS (SELECT *, CASE WHEN main_mass > 0.01 THEN tail_mass / main_mass END AS tail_main_ratio,
  CASE WHEN total_pairs = 0 THEN 'unavailable_empty_total' WHEN background_pairs = 0 THEN 'unavailable_empty_background'
       WHEN NOT tail_supported THEN 'unavailable_sparse_tail' WHEN beta IS NULL THEN 'unavailable_invalid_distribution'
       WHEN NOT abs(signed_area) > 0.01 THEN 'unavailable_near_zero_signed_area' ELSE 'available_shape' END AS status,
  CASE WHEN main_mass > 0.01 THEN 'available' WHEN NOT tail_supported THEN 'unavailable_sparse_tail'
       WHEN beta IS NULL THEN 'unavailable_invalid_distribution' ELSE 'unavailable_main_mass_not_above_guard' END AS ratio_status FROM guarded)"""
SUMMARY_VALUES = ("beta_raw", "beta", "signed_area", "main_mass", "tail_mass", "negative_mass", "tail_main_ratio")


def scopes(t):
    """The full movie and ten equal windows of it, from the first frame of the points to the last."""
    span = t.movies.agg(F.min("frame").alias("lo"), (F.max("frame") + 1).alias("hi")).where("lo is not null")
    span = span.withColumn("step", F.ceil((F.col("hi") - F.col("lo")) / F.lit(float(WINDOWS))).cast("int"))
    parts = [F.struct(F.lit("full").alias("scope"), F.col("lo").alias("start"), F.col("hi").alias("stop"))]
    parts += [F.struct(F.lit(f"w{k}").alias("scope"), (F.col("lo") + k * F.col("step")).alias("start"),
                       F.least(F.col("hi"), F.col("lo") + (k + 1) * F.col("step")).alias("stop")) for k in range(WINDOWS)]
    return span.select(F.inline(F.array(*parts))).where("start < stop")


def movie_counts(t, points=None):
    return pr.grouped_pair_counts(t.movies if points is None else points, max_distance=MAX_UM, n_bins=N_BINS)


def movie_curves(t, points=None):
    return scoped_curves(movie_counts(t, points), scopes(t), max_distance=MAX_UM, n_bins=N_BINS)


def movie_summary(t, points=None):
    return dc.guarded_summary(movie_curves(t, points), KEYS, n_bins=N_BINS, width=WIDTH_UM)


@query("grouped_pair_counts", "JOIN-3 JOIN-4 JOIN-5 AGG-3", f"{G} SELECT sample_id, component, grp, frame, bin, n FROM gcounts")
def grouped_pair_counts(t):
    return movie_counts(t)


@query("derived_pair_totals", "AGG-4",
       f"""{G} SELECT sample_id, CASE WHEN component IN ('total', 'cross') THEN 'all_total' ELSE 'all_background' END AS component,
       frame, bin, CAST(sum(n) AS BIGINT) AS n FROM gcounts GROUP BY ALL""")
def derived_pair_totals(t):
    return pr.derived_totals(movie_counts(t))


@query("valid_endpoint_pair_counts", "JOIN-6",
       f"""WITH {POINTS}, ok AS (SELECT * FROM movies WHERE frame % 97 <> 13), {gcounts_sql('ok')}
       SELECT sample_id, component, grp, bin, CAST(sum(n) AS BIGINT) AS n FROM gcounts GROUP BY ALL""")
def valid_endpoint_pair_counts(t):
    # validity is known per frame, the same for every sample here
    valid = t.movies.select("sample_id", "frame").distinct().join(
        t.frame_map.where("participating").select("frame"), "frame", "left_semi")
    c = pr.grouped_pair_counts(t.movies, max_distance=MAX_UM, n_bins=N_BINS, valid_frames=valid)
    return c.groupBy("sample_id", "component", "grp", "bin").agg(F.sum("n").alias("n"))


@query("scope_pooled_counts", "AGG-5",
       f"""{S} SELECT sample_id, grp, scope, component, bin, CAST(n AS BIGINT) AS n FROM pool""")
def scope_pooled_counts(t):
    return pr.pool_scopes(movie_counts(t), scopes(t))


@query("scope_decomposition", "AGG-9 AGG-10",
       f"""{S}, {GUARD} SELECT sample_id, grp, scope, CAST(total_pairs AS BIGINT) AS total_pairs, CAST(background_pairs AS BIGINT) AS background_pairs,
       CAST(total_tail_pairs AS BIGINT) AS total_tail_pairs, CAST(background_tail_pairs AS BIGINT) AS background_tail_pairs,
       tail_supported, {R_all(*SUMMARY_VALUES)}, status, ratio_status FROM summary""")
def scope_decomposition(t):
    return round_all(movie_summary(t), *SUMMARY_VALUES)


@query("scope_field_status", "AGG-10",
       f"""{S}, {GUARD}, f AS (SELECT *, CASE WHEN tail_supported AND beta IS NOT NULL THEN 'available' WHEN NOT tail_supported THEN 'unavailable_sparse_tail'
         ELSE 'unavailable_invalid_distribution' END AS derived FROM summary)
       SELECT sample_id, grp, scope, field, CASE field
         WHEN 'total' THEN CASE WHEN total_pairs > 0 THEN 'available' ELSE 'unavailable_empty_total' END
         WHEN 'background' THEN CASE WHEN background_pairs > 0 THEN 'available' ELSE 'unavailable_empty_background' END
         WHEN 'shape' THEN status ELSE derived END AS field_status
       FROM f CROSS JOIN (VALUES ('total'), ('background'), ('inter'), ('intra'), ('shape')) v(field)""")
def scope_field_status(t):
    return dc.field_status(movie_summary(t)).select(*KEYS, "field", "field_status")


@query("tail_diagnostics", "AGG-11",
       f"""{S}, q AS (SELECT *, total / nullif(sum(total) OVER w, 0) AS tn, background / nullif(sum(background) OVER w, 0) AS bn
         FROM split WHERE bin >= 21 WINDOW w AS (PARTITION BY sample_id, grp, scope))
       SELECT sample_id, grp, scope, {R('sum(abs(tn - bn))')} AS tail_l1,
         {R('sum(total * background) / nullif(sqrt(sum(total * total) * sum(background * background)), 0)')} AS tail_cosine,
         {R('max(abs(intra))')} AS max_abs_residual, {R('sum(intra * intra)')} AS residual_ss FROM q GROUP BY ALL""")
def tail_diagnostics(t):
    return round_all(dc.tail_diagnostics(movie_curves(t), KEYS, n_bins=N_BINS), "tail_l1", "tail_cosine", "max_abs_residual", "residual_ss")


@query("tail_count_shares", "CUR-11",
       f"""{S} SELECT sample_id, grp, bin, CAST(t AS BIGINT) AS total_n, CAST(b AS BIGINT) AS background_n,
       {R('t / nullif(sum(t) OVER w, 0)')} AS total_share, {R('b / nullif(sum(b) OVER w, 0)')} AS background_share
       FROM split WHERE scope = 'full' AND bin >= 21 WINDOW w AS (PARTITION BY sample_id, grp)""")
def tail_count_shares(t):
    from pyspark.sql import Window

    w = Window.partitionBy("sample_id", "grp")
    tail = movie_curves(t).where("scope = 'full' and bin >= 21")
    share = lambda c: rounded(F.when(F.sum(c).over(w) > 0, F.col(c) / F.sum(c).over(w)))
    return tail.select("sample_id", "grp", "bin", "total_n", "background_n",
                       share("total_n").alias("total_share"), share("background_n").alias("background_share"))


SHAPES = """shapes AS (SELECT sample_id, grp, scope, bin, mid_um, s.intra, status,
  CASE WHEN status = 'available_shape' THEN s.intra / signed_area END AS shape,
  CASE WHEN status = 'available_shape' AND max(s.intra) OVER w > 0 THEN s.intra / (max(s.intra) OVER w) END AS peak
  FROM split s JOIN summary USING (sample_id, grp, scope) WINDOW w AS (PARTITION BY sample_id, grp, scope))"""


def shapes(t, points=None):
    """Area and peak normalized curves, NULL where the guard of that curve fails."""
    return dc.with_shape(movie_curves(t, points), KEYS, n_bins=N_BINS)


@query("curve_derivatives", "CUR-12",
       f"""{S}, {GUARD}, {SHAPES} SELECT sample_id, grp, scope, bin, {R('intra')} AS intra, {R('shape')} AS shape, {R('peak')} AS peak, status FROM shapes""")
def curve_derivatives(t):
    return round_all(shapes(t), "intra", "shape", "peak").select(*KEYS, "bin", "intra", "shape", "peak", "status")


DIFF = ("max_abs_difference", "max_abs_difference_um", "integrated_abs_difference", "main_difference", "tail_difference")


def diff_sql(cte: str, keys: str) -> str:
    return f"""d AS ({cte}),
    e AS (SELECT {keys}, count(d) = count(*) AS available, max(abs(d)) AS max_abs_difference, arg_max(mid_um, {{'s': abs(d), 'o': -bin}}) FILTER (d IS NOT NULL) AS max_abs_difference_um,
      sum(abs(d) * CAST(0.1 AS DOUBLE)) AS integrated_abs_difference,
      sum(CASE WHEN mid_um < CAST(0.1 AS DOUBLE) THEN d * CAST(0.1 AS DOUBLE) ELSE 0 END) AS main_difference,
      sum(CASE WHEN mid_um >= CAST(0.1 AS DOUBLE) AND mid_um < 0.25 THEN d * CAST(0.1 AS DOUBLE) ELSE 0 END) AS tail_difference FROM d GROUP BY ALL)
    SELECT {keys}, available, {', '.join(f"{R(f'CASE WHEN available THEN {c} END')} AS {c}" for c in DIFF)} FROM e"""


@query("on_vs_not_on_difference", "JOIN-28 SRT-2",
       f"""{S}, {GUARD}, {SHAPES}, {diff_sql('''SELECT a.sample_id, a.scope, a.bin, a.mid_um, a.shape / CAST(0.1 AS DOUBLE) - b.shape / CAST(0.1 AS DOUBLE) AS d FROM shapes a JOIN shapes b
         ON a.sample_id = b.sample_id AND a.scope = b.scope AND a.bin = b.bin WHERE a.grp = 'On' AND b.grp = 'Not-on' ''', 'sample_id, scope')}""")
def on_vs_not_on_difference(t):
    s = shapes(t).withColumn("density", F.col("shape") / WIDTH_UM)
    return round_all(cv.group_difference(s, ["sample_id", "scope"], "density", width=WIDTH_UM), *DIFF)


OTHER = "other AS (SELECT * REPLACE (CASE WHEN y_um < 1.5 THEN 'On' ELSE 'Not-on' END AS grp) FROM movies WHERE grp <> 'unknown')"


def relabeled_counts(t):
    """Pair counts of the known points by their group, and by a second labeling from their position."""
    points = t.movies.where("grp <> 'unknown'").withColumn("place", F.when(F.col("y_um") < 1.5, "On").otherwise("Not-on"))
    return pr.relabeled_pair_counts(points, "place", max_distance=MAX_UM, n_bins=N_BINS)


@query("method_curve_comparison", "JOIN-27",
       f"""WITH {POINTS}, {OTHER}, {SCOPE_SQL}, {gcounts_sql('movies', 'ca')}, {gcounts_sql('other', 'cb')},
       {scoped_sql('ca', 'a_')}, {scoped_sql('cb', 'b_')},
       sa AS (SELECT sample_id, grp, scope, max(beta) AS beta, sum(intra) AS area FROM a_split GROUP BY ALL),
       sb AS (SELECT sample_id, grp, scope, max(beta) AS beta, sum(intra) AS area FROM b_split GROUP BY ALL)
       SELECT sample_id, grp, scope, {R('any_value(sb.beta - sa.beta)')} AS beta_change, {R('any_value(sb.area - sa.area)')} AS signed_area_change,
         {R('max(abs(b.intra - a.intra))')} AS max_abs_change, {R('sum(abs(b.intra - a.intra))')} AS integrated_abs_change
       FROM a_split a JOIN b_split b USING (sample_id, grp, scope, bin) JOIN sa USING (sample_id, grp, scope) JOIN sb USING (sample_id, grp, scope)
       GROUP BY ALL""")
def method_curve_comparison(t):
    a, b = (scoped_curves(c, scopes(t), max_distance=MAX_UM, n_bins=N_BINS) for c in relabeled_counts(t))
    a = a.select(*KEYS, "bin", F.col("beta").alias("beta_a"), F.col("intra").alias("a"))
    b = b.select(*KEYS, "bin", F.col("beta").alias("beta_b"), F.col("intra").alias("b"))
    d = a.join(b, [*KEYS, "bin"]).groupBy(*KEYS).agg(
        F.max(F.col("beta_b") - F.col("beta_a")).alias("beta_change"), (F.sum("b") - F.sum("a")).alias("signed_area_change"),
        F.max(F.abs(F.col("b") - F.col("a"))).alias("max_abs_change"), F.sum(F.abs(F.col("b") - F.col("a"))).alias("integrated_abs_change"))
    return round_all(d, "beta_change", "signed_area_change", "max_abs_change", "integrated_abs_change")


@query("relabel_invariance", "JOIN-35",
       f"""WITH {POINTS}, {OTHER}, {gcounts_sql('movies', 'ca')}, {gcounts_sql('other', 'cb')},
       na AS (SELECT sample_id, CASE WHEN component IN ('total', 'cross') THEN 'all_total' ELSE 'all_background' END AS component, sum(n) AS n FROM ca GROUP BY ALL),
       nb AS (SELECT sample_id, CASE WHEN component IN ('total', 'cross') THEN 'all_total' ELSE 'all_background' END AS component, sum(n) AS n FROM cb GROUP BY ALL)
       SELECT sample_id, component, CAST(na.n AS BIGINT) AS n_a, CAST(nb.n AS BIGINT) AS n_b, na.n IS NOT DISTINCT FROM nb.n AS equal
       FROM na FULL JOIN nb USING (sample_id, component)""")
def relabel_invariance(t):
    return lb.relabel_invariance(*map(pr.derived_totals, relabeled_counts(t)))


# background and widths of the fit stand in from other columns of the points
WIDTHS = {"bg_e_per_pixel": "y_se_px * 10 + x_se_px", "sx_px": "1 + x_um / 10", "sy_px": "1 + y_um / 10"}
QCOLS = ("x_se_nm", "y_se_nm", "photons_e", *WIDTHS)
SCOPE_STATS = f"""st AS (SELECT sample_id, grp, scope, count(*) AS points_n, {', '.join(f"quantile_cont({c}, 0.1) AS {c}_q10, quantile_cont({c}, 0.5) AS {c}_median, quantile_cont({c}, 0.9) AS {c}_q90" for c in QCOLS)}
  FROM (SELECT *, {', '.join(f"{e} AS {c}" for c, e in WIDTHS.items())} FROM movies) JOIN scopes ON frame >= start AND frame < stop WHERE grp <> 'unknown' GROUP BY ALL)"""
QNAMES = [f"{c}_{q}" for c in QCOLS for q in ("q10", "median", "q90")]


def scope_statistics(t, columns=QCOLS, probs=(0.1, 0.5, 0.9)):
    """Exact quantiles of the columns per sample, group and frame range."""
    frames = scopes(t).select("scope", F.explode(F.sequence("start", F.col("stop") - 1)).alias("frame"))
    rows = t.movies.where("grp <> 'unknown'").join(F.broadcast(frames), "frame")  # four ranges of a fixed 360 frames
    rows = rows.withColumns({c: F.expr(e) for c, e in WIDTHS.items()})
    long = rows.unpivot(KEYS, list(columns), "metric", "value")
    q = exact_quantiles(long, [*KEYS, "metric"], "value", probs, reread=True)
    name = F.when(F.col("prob") == 0.1, "q10").when(F.col("prob") == 0.5, "median").otherwise("q90")
    wide = q.withColumn("name", F.concat_ws("_", "metric", name)).groupBy(*KEYS).pivot("name", [n for n in QNAMES if n.startswith(tuple(columns))]).agg(F.max("quantile"))
    return rows.groupBy(*KEYS).agg(F.count("*").alias("points_n")).join(wide, KEYS)


@query("scope_localization_statistics", "AGG-30", f"WITH {POINTS}, {SCOPE_SQL}, {SCOPE_STATS} SELECT sample_id, grp, scope, points_n, {R_all(*QNAMES)} FROM st")
def scope_localization_statistics(t):
    return round_all(scope_statistics(t), *QNAMES)


@query("decomposition_with_statistics", "JOIN-32",
       f"""{S}, {GUARD}, {SCOPE_STATS} SELECT sample_id, grp, scope, status, {R('beta')} AS beta, points_n, {R('photons_e_median')} AS photons_e_median
       FROM summary LEFT JOIN st USING (sample_id, grp, scope)""")
def decomposition_with_statistics(t):
    s = movie_summary(t).select(*KEYS, "status", "beta")
    return round_all(s.join(scope_statistics(t, ["photons_e"], [0.5]).select(*KEYS, "points_n", "photons_e_median"), KEYS, "left"), "beta", "photons_e_median")


@query("label_attachment", "JOIN-7 PRJ-8 PRJ-10 PRJ-11 SET-4",
       f"""WITH {POINTS}, l AS (SELECT uid, CASE grp WHEN 'On' THEN 'mito-compatible' WHEN 'Not-on' THEN 'non-mito-compatible' ELSE 'unknown' END AS label FROM selected)
       SELECT sample_id, CASE WHEN label IS NULL THEN 'points_only' ELSE 'both' END AS side,
         CASE label WHEN 'mito-compatible' THEN 'On' WHEN 'non-mito-compatible' THEN 'Not-on' ELSE label END AS attached, count(*) AS n
       FROM points LEFT JOIN l USING (uid) GROUP BY ALL""")
def label_attachment(t):
    names = F.when(F.col("grp") == "On", "mito-compatible").when(F.col("grp") == "Not-on", "non-mito-compatible").otherwise("unknown")
    saved = t.selected.select("uid", names.alias("postmin32_pointwise_label"))
    saved = ck.first_present(saved, ["classification_label", "postmin32_pointwise_label"], "label")
    joined = lb.attach_labels(t.points.select("uid", "sample_id"), saved)
    return joined.groupBy("sample_id", "side", lb.recode(F.col("label")).alias("attached")).agg(F.count("*").alias("n"))


@query("uid_duplicates", "PRJ-7 PRJ-15",
       f"""WITH {POINTS}, u AS (SELECT concat_ws(':', CAST(sample_id AS VARCHAR), CAST(frame AS VARCHAR)) AS uid2 FROM points)
       SELECT uid2 AS spot_uid, count(*) AS n FROM u GROUP BY 1 HAVING count(*) > 1""")
def uid_duplicates(t):
    return ck.duplicate_keys(t.points.select(F.concat_ws(":", "sample_id", "frame").alias("spot_uid")), ["spot_uid"])


@query("selected_row_violations", "PRJ-5 PRJ-9 PRJ-12 PRJ-13",
       f"""WITH {POINTS}, q AS (SELECT *, frame * CAST(0.02 AS DOUBLE) AS time_s, CASE WHEN photons_e > 900 THEN 'full_observed_Hessian' ELSE 'partial' END AS us FROM points)
       SELECT sample_id, count(*) AS rows_n, "check", CASE "check" WHEN 'positive_error' THEN count(*) FILTER (NOT (x_se_nm > 50 AND y_se_nm > 0))
          WHEN 'frame_in_range' THEN count(*) FILTER (frame < 0 OR frame > 300) WHEN 'error_semantics' THEN count(*) FILTER (us = 'partial')
          WHEN 'strict_flag' THEN count(*) FILTER (NOT qc) ELSE 0 END AS violations
       FROM q CROSS JOIN (VALUES ('finite_position'), ('positive_error'), ('known_label'), ('frame_in_range'), ('time_matches_frame'), ('error_semantics'), ('strict_flag')) c("check")
       GROUP BY sample_id, c."check" """)
def selected_row_violations(t):
    p = t.points.withColumns({
        "time_s": F.col("frame") * F.lit(FRAME_S), "x_se_nm": F.when(F.col("x_se_nm") > 50, F.col("x_se_nm")).otherwise(-1.0),
        "uncertainty_status": F.when(F.col("photons_e") > 900, "full_observed_Hessian").otherwise("partial")})
    tests = lb.selected_expectations(n_frames=301, frame_s=FRAME_S) + [("strict_flag", strict_bool(F.col("qc").cast("string")))]
    return ck.violation_counts(p, tests, ["sample_id"])


@query("fit_detection_by_index", "JOIN-8",
       f"""WITH {POINTS}, d AS (SELECT sample_id, uid, frame, row_number() OVER (PARTITION BY sample_id ORDER BY frame, x_um, y_um, uid) - 1 AS i FROM points),
       f AS (SELECT sample_id, i, uid FROM d WHERE i % 11 <> 2 UNION ALL SELECT sample_id, i, uid FROM d WHERE i % 29 = 3 UNION ALL SELECT sample_id, i + 1000000, uid FROM d WHERE i % 31 = 4),
       m AS (SELECT sample_id, i, count(*) AS n FROM f GROUP BY ALL)
       SELECT sample_id, count(m.n) AS fitted_candidates, CAST(coalesce(sum(m.n), 0) AS BIGINT) AS fits, count(*) FILTER (m.n > 1) AS fitted_twice,
         count(*) FILTER (m.n IS NULL) AS without_fit, count(*) FILTER (d.here IS NULL) AS without_detection, bool_and(coalesce(m.n = 1 AND d.here, false)) AS one_to_one
       FROM (SELECT sample_id, i, true AS here FROM d) d FULL JOIN m USING (sample_id, i) GROUP BY sample_id""")
def fit_detection_by_index(t):
    """Fits refer to detections by candidate index; some are missing, some come twice, some point nowhere."""
    detections = pt.candidate_index(t.points.select("uid", "sample_id", "frame", "x_um", "y_um"))
    i = F.col("candidate_index")
    fits = detections.where(i % 11 != 2).unionByName(detections.where(i % 29 == 3)).unionByName(
        detections.where(i % 31 == 4).withColumn("candidate_index", i + 1_000_000))
    return lb.index_match_report(fits.select("sample_id", "candidate_index"), detections.select("sample_id", "candidate_index"))


@query("localization_table_violations", "PRJ-14 JOIN-9 JOIN-10",
       f"""WITH {POINTS}, d AS (SELECT uid, frame, x_px FROM points WHERE photons_e > 5000),
       j AS (SELECT p.sample_id, d.uid AS du FROM points p LEFT JOIN d USING (uid))
       SELECT sample_id, count(*) AS rows_n, "check", CASE WHEN "check" IN ('detection_exists', 'same_frame', 'same_position')
         THEN count(*) FILTER (du IS NULL) ELSE 0 END AS violations
       FROM j CROSS JOIN (VALUES ('uid_suffix'), ('detection_exists'), ('same_frame'), ('same_position'), ('selected_implies_qc')) c("check") GROUP BY sample_id, c."check" """)
def localization_table_violations(t):
    detections = t.points.where("photons_e > 5000").select(
        "uid", F.col("frame").alias("d_frame"), F.col("x_px").alias("d_x_px"), F.col("y_px").alias("d_y_px"))
    fits = t.points.withColumns({"spot_id": F.element_at(F.split("uid", "-"), -1), "selected": F.col("qc")})
    return ck.violation_counts(fits.join(detections, "uid", "left"), lb.table_expectations(), ["sample_id"])


@query("detection_match_violations", "PRJ-14 JOIN-9 JOIN-10",
       f"""WITH {POINTS}, k AS (SELECT *, CAST(split_part(uid, '-', 1) AS BIGINT) AS k FROM points)
       SELECT sample_id, count(*) AS rows_n, "check", CASE "check" WHEN 'uid_suffix' THEN count(*) FILTER (k % 17 = 3)
         WHEN 'detection_exists' THEN count(*) FILTER (k % 13 = 2) WHEN 'same_frame' THEN count(*) FILTER (k % 13 = 2 OR k % 11 = 4)
         WHEN 'same_position' THEN count(*) FILTER (k % 13 = 2 OR k % 7 IN (2, 3)) ELSE count(*) FILTER (k % 19 = 5 AND NOT qc) END AS violations
       FROM k CROSS JOIN (VALUES ('uid_suffix'), ('detection_exists'), ('same_frame'), ('same_position'), ('selected_implies_qc')) c("check") GROUP BY sample_id, c."check" """)
def detection_match_violations(t):
    """Fits against a detection table of its own: rows missing, frames moved, places off by more and by less than the tolerance."""
    k = F.split("uid", "-")[0].cast("bigint")
    off = F.when(k % 7 == 1, 5e-11).when(k % 7 == 2, 5e-10).otherwise(0.0)
    detections = t.points.where(k % 13 != 2).select(
        "uid", F.when(k % 11 == 4, F.col("frame") + 1).otherwise(F.col("frame")).alias("d_frame"), (F.col("x_px") + off).alias("d_x_px"),
        (F.col("y_px") - F.when(k % 7 == 3, 2e-10).otherwise(0.0)).alias("d_y_px"))
    fits = t.points.withColumns({
        "spot_id": F.when(k % 17 == 3, "none").otherwise(F.element_at(F.split("uid", "-"), -1)), "selected": F.col("qc") | (k % 19 == 5)})
    return ck.violation_counts(fits.join(detections, "uid", "left"), lb.table_expectations(), ["sample_id"])


@query("flag_text_violations", "PRJ-5",
       f"""WITH {POINTS}, q AS (SELECT sample_id, CASE CAST(split_part(uid, '-', 1) AS BIGINT) % 6 WHEN 0 THEN 'True' WHEN 1 THEN ' false ' WHEN 2 THEN 'yes' WHEN 3 THEN '' WHEN 4 THEN '1' ELSE 'no?' END AS flag FROM points)
       SELECT sample_id, count(*) FILTER (flag IN ('True', '1')) AS true_n, count(*) FILTER (flag = ' false ') AS false_n,
         count(*) FILTER (flag IN ('yes', '', 'no?')) AS bad_n FROM q GROUP BY 1""")
def flag_text_violations(t):
    """Flags as text in several spellings; what is neither true nor false is counted, not guessed."""
    texts = F.array(*[F.lit(x) for x in ("True", " false ", "yes", "", "1", "no?")])
    flag = strict_bool(F.get(texts, (F.split("uid", "-")[0].cast("bigint") % 6).cast("int")))
    return t.points.groupBy("sample_id").agg(
        F.count_if(flag).alias("true_n"), F.count_if(~flag).alias("false_n"), F.count_if(flag.isNull()).alias("bad_n"))


FRAMES = f"""WITH {POINTS}, f AS (SELECT unnest(range(min(frame), max(frame) + 1)) AS frame FROM points),
  m AS (SELECT sample_id % 20 AS sample_id, frame, grp, qc, x_um, y_um, photons_e FROM points), s AS (SELECT DISTINCT sample_id FROM m),
  fc AS (SELECT s.sample_id, f.frame, count(*) FILTER (qc AND grp = 'On') AS "on", count(*) FILTER (qc AND grp = 'Not-on') AS not_on,
    count(*) FILTER (qc AND grp = 'unknown') AS unknown, count(*) FILTER (NOT qc) AS qc_excluded, count(m.qc) AS roi_candidates
    FROM s CROSS JOIN f LEFT JOIN m ON m.sample_id = s.sample_id AND m.frame = f.frame GROUP BY ALL)"""


def all_movie_points(t):
    return t.points.withColumn("sample_id", F.col("sample_id") % 20)


@query("frame_class_counts", "AGG-13", f"{FRAMES} SELECT * FROM fc")
def frame_class_counts(t):
    return lb.frame_class_counts(all_movie_points(t))


@query("block_class_counts", "AGG-14",
       f"""{FRAMES}, b AS (SELECT *, frame // 25 AS block FROM fc)
       SELECT sample_id, CAST(block AS INTEGER) AS block, grouping(block) AS is_total, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('"on"', 'not_on', 'unknown', 'qc_excluded', 'roi_candidates'))}
       FROM b GROUP BY GROUPING SETS ((sample_id, block), (sample_id))""")
def block_class_counts(t):
    return lb.block_rollup(lb.frame_class_counts(all_movie_points(t)), block_frames=25)


@query("count_conservation_violations", "PRJ-24",
       f"""{FRAMES} SELECT sample_id, frame, "on" + 1 AS "on", not_on, unknown, qc_excluded, roi_candidates FROM fc WHERE frame % 50 = 7
       UNION ALL SELECT sample_id, frame, "on", not_on, unknown, 0, roi_candidates FROM fc WHERE frame % 50 = 8 AND qc_excluded > 0""")
def count_conservation_violations(t):
    """Counts with one point too many in some frames and excluded points forgotten in others: only those are reported."""
    frame = F.col("frame")
    faulty = lb.frame_class_counts(all_movie_points(t)).withColumns({
        "on": F.when(frame % 50 == 7, F.col("on") + 1).otherwise(F.col("on")),
        "qc_excluded": F.when(frame % 50 == 8, F.lit(0)).otherwise(F.col("qc_excluded"))})
    return lb.conservation_violations(faulty)


@query("frame_audit_counts", "AGG-58",
       f"""{FRAMES} SELECT s.sample_id, f.frame, count(*) FILTER (qc) AS ok, count(*) FILTER (NOT qc AND photons_e < 30000) AS dim,
       count(*) FILTER (NOT qc AND photons_e >= 30000) AS poor_fit, count(*) FILTER (qc) AS selected, count(*) FILTER (NOT qc) AS excluded
       FROM s CROSS JOIN f LEFT JOIN m ON m.sample_id = s.sample_id AND m.frame = f.frame GROUP BY ALL""")
def frame_audit_counts(t):
    audit = F.when(F.col("qc"), "ok").when(F.col("photons_e") < 30000, "dim").otherwise("poor_fit")
    return lb.audit_counts(all_movie_points(t).withColumn("audit", audit), statuses=["ok", "dim", "poor_fit"])


@query("frame_detection_counts", "AGG-59",
       f"""{FRAMES} SELECT s.sample_id, f.frame, count(m.qc) AS whole_field, count(*) FILTER (x_um BETWEEN 0.5 AND 2.5 AND y_um BETWEEN 0.5 AND 2.5) AS inside
       FROM s CROSS JOIN f LEFT JOIN m ON m.sample_id = s.sample_id AND m.frame = f.frame GROUP BY ALL""")
def frame_detection_counts(t):
    inside = F.col("x_um").between(0.5, 2.5) & F.col("y_um").between(0.5, 2.5)
    return lb.detection_counts(all_movie_points(t), inside=inside)


@query("label_transition_matrix", "AGG-22",
       f"""WITH {LABELINGS}, g AS (SELECT unnest(['On', 'Not-on', 'unknown']) AS l)
       SELECT p.l AS from_label, q.l AS to_label, count(x.uid) AS n FROM g p CROSS JOIN g q LEFT JOIN labelings x ON x.a = p.l AND x.b = q.l GROUP BY ALL""")
def label_transition_matrix(t):
    return lb.transition_matrix(t.labelings)


@query("label_flip_counts", "AGG-23",
       f"""WITH {LABELINGS} SELECT count(*) FILTER (a = 'On' AND b = 'Not-on') AS on_to_not_on, count(*) FILTER (a = 'Not-on' AND b = 'On') AS not_on_to_on,
       count(*) FILTER (a <> b AND 'unknown' IN (a, b)) AS unknown_involved, count(*) FILTER (a = b) AS unchanged FROM labelings""")
def label_flip_counts(t):
    return lb.flip_counts(t.labelings)


@query("label_method_counts", "AGG-24",
       f"""WITH {LABELINGS}, l AS (SELECT method, label, c FROM (SELECT 'a' AS method, a AS label, a <> 'unknown' AND b <> 'unknown' AS c FROM labelings
         UNION ALL SELECT 'b', b, a <> 'unknown' AND b <> 'unknown' FROM labelings))
       SELECT method, count(*) AS items, count(*) FILTER (label = 'On') AS on_n, count(*) FILTER (label = 'Not-on') AS not_on_n,
         count(*) FILTER (label = 'unknown') AS unknown_n, count(*) FILTER (c) AS common_known,
         {R("count(*) FILTER (label = 'On') * 100.0 / count(*) FILTER (label <> 'unknown')")} AS on_pct,
         {R("count(*) FILTER (label = 'On' AND c) * 100.0 / count(*) FILTER (label <> 'unknown' AND c)")} AS on_pct_common FROM l GROUP BY 1""")
def label_method_counts(t):
    return round_all(lb.method_counts(t.labelings), "on_pct", "on_pct_common")


@query("identity_disagreements", "PRJ-16",
       f"""WITH {POINTS} SELECT count(*) FILTER (frame >= 300) AS frame, count(*) FILTER (grp = 'unknown') AS grp FROM points""")
def identity_disagreements(t):
    return lb.identity_disagreements(t.points, {
        "frame": F.least(F.col("frame"), F.lit(299)),
        "grp": F.when(F.col("grp") == "unknown", "known").otherwise(F.col("grp"))})
