"""Replicate, condition and comparison roll-ups of curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from stipple.catalog.displacement import BASE, POSITIVE_COLUMNS, R_all, positive_sql, round_all
from stipple.catalog.registry import CURVES, INVENTORY, R, query
from stipple.functions.columns import rounded
from stipple.operators import curves as cv
from stipple.operators import hierarchy as hi
from stipple.plans.displacement import cell_curves
from stipple.sources.standins import MAX_UM, N_BINS, WIDTH_UM
from stipple.sources.tables import stored

W64 = 1 / 64
GROUPS = ("On", "Not-on")
PARTS = ("total", "inter", "intra")


def sited(t):
    """Decomposed cell curves with their replicate and condition."""
    c = cell_curves(t.points, max_distance=MAX_UM, n_bins=N_BINS)
    return c.join(t.inventory.where("sample_id is not null"), "sample_id")


SITED = f"{BASE}, {INVENTORY}, sited AS (SELECT * FROM split JOIN inventory USING (sample_id))"
REPL = f"""{SITED}, repl AS (SELECT condition, br, bin, avg(total) AS total, avg("inter") AS "inter", avg(intra) AS intra,
  count(*) AS n_cells, any_value(left_um) AS left_um, any_value(right_um) AS right_um, any_value(mid_um) AS mid_um
  FROM sited GROUP BY condition, br, bin)"""


def with_grid(df):
    b = F.col("bin")
    return df.withColumns({"left_um": b * F.lit(WIDTH_UM), "right_um": (b + 1) * F.lit(WIDTH_UM), "mid_um": (b + 0.5) * F.lit(WIDTH_UM)})


def replicate_curves(t):
    return with_grid(hi.equal_cell_mean(sited(t), ["condition", "br"], PARTS))


@query("replicate_distribution", "AGG-32 SNK-2",
       f"""{REPL} SELECT condition, br, bin, {R_all('total')}, {R('"inter"')} AS "inter", {R_all('intra')}, n_cells FROM repl""")
def replicate_distribution(t):
    r = hi.equal_cell_mean(sited(t), ["condition", "br"], PARTS)
    return stored(round_all(r, *PARTS))


@query("condition_equal_cell_mean", "AGG-34",
       f"""{SITED} SELECT condition, bin, {R('avg(total)')} AS total, {R('avg("inter")')} AS "inter", {R('avg(intra)')} AS intra,
       count(*) AS n_cells, {R('sum(avg("inter")) OVER (PARTITION BY condition)')} AS beta FROM sited GROUP BY condition, bin""")
def condition_equal_cell_mean(t):
    from pyspark.sql import Window

    r = hi.equal_cell_mean(sited(t), ["condition"], PARTS)
    r = r.withColumn("beta", F.sum("inter").over(Window.partitionBy("condition")))
    return round_all(r, *PARTS, "beta")


@query("replicate_totals", "AGG-33 SNK-4",
       f"""{SITED}, cells AS (SELECT DISTINCT condition, br, sample_id, beta, tp, bp FROM sited)
       SELECT condition, br, count(*) AS n_cells, {R('avg(beta)')} AS beta, CAST(sum(tp) AS BIGINT) AS total_pairs,
       CAST(sum(bp) AS BIGINT) AS background_pairs FROM cells GROUP BY ALL""")
def replicate_totals(t):
    cells = sited(t).groupBy("condition", "br", "sample_id").agg(
        F.max("beta").alias("beta"), F.max("total_pairs").alias("total_pairs"), F.max("background_pairs").alias("background_pairs"))
    return stored(round_all(hi.replicate_totals(cells, ["condition", "br"]), "beta"))


BAND = ("mean", "sd", "sem", "low", "high")
BAND_SQL = """count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, stddev_samp(value) / sqrt(count(value)) AS sem,
  avg(value) - stddev_samp(value) AS low, avg(value) + stddev_samp(value) AS high"""


@query("group_distribution", "AGG-35 SNK-5",
       f"""{REPL}, long AS (SELECT condition, bin, component, value FROM (
         SELECT condition, bin, 'total' AS component, total AS value FROM repl UNION ALL
         SELECT condition, bin, 'inter', "inter" FROM repl UNION ALL SELECT condition, bin, 'intra', intra FROM repl)),
       b AS (SELECT condition, component, bin, {BAND_SQL} FROM long GROUP BY ALL)
       SELECT condition, component, bin, n, {R_all(*BAND)} FROM b""")
def group_distribution(t):
    return stored(round_all(hi.equal_replicate_band(replicate_curves(t), ["condition"], PARTS), *BAND))


@query("group_distribution_wide", "SNK-5 SNK-11",
       f"""{REPL} SELECT bin, {', '.join(f'''{R(f"avg(intra) FILTER (condition = '{c}')")} AS "{c}_mean", {R(f"stddev_samp(intra) FILTER (condition = '{c}')")} AS "{c}_sd"''' for c in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'))}
       FROM repl GROUP BY bin""")
def group_distribution_wide(t):
    # the condition table gives the columns: one of each condition, whatever there are
    names = [r[0] for r in t.raw("region").select("r_name").distinct().orderBy("r_name").collect()]
    wide = replicate_curves(t).groupBy("bin").pivot("condition", names).agg(
        F.avg("intra").alias("mean"), F.stddev_samp("intra").alias("sd"))
    return stored(round_all(wide, *[c for c in wide.columns if c != "bin"]))


@query("replicate_metric_statistics", "AGG-36 SNK-6 CUR-13",
       f"""{REPL}, {positive_sql('repl', 'condition, br', 'intra')},
       long AS (SELECT condition, 'peak_um' AS metric, peak_um AS value FROM positive UNION ALL
                SELECT condition, 'near_mass', near_mass FROM positive UNION ALL
                SELECT condition, 'mean_um', mean_um FROM positive UNION ALL
                SELECT condition, 'median_um', median_um FROM positive),
       b AS (SELECT condition, metric, count(*) AS n_rows, {BAND_SQL} FROM long GROUP BY ALL)
       SELECT condition, metric, n_rows, n, {R_all(*BAND)} FROM b""")
def replicate_metric_statistics(t):
    s = cv.positive_summary(replicate_curves(t), ["condition", "br"], "intra")
    return stored(round_all(hi.metric_statistics(s, ["condition"], ["peak_um", "near_mass", "mean_um", "median_um"]), *BAND))


@query("group_mean_curve_summary", "CUR-7 CUR-8",
       f"""{REPL}, mean_curve AS (SELECT condition, bin, any_value(left_um) AS left_um, any_value(right_um) AS right_um,
         any_value(mid_um) AS mid_um, avg(intra) AS intra FROM repl GROUP BY condition, bin),
       {positive_sql('mean_curve', 'condition', 'intra')}
       SELECT condition, peak_bin, {R_all(*POSITIVE_COLUMNS)}, {R('peak_um * 1000')} AS mode_nm, {R('mean_um * 1000')} AS mean_nm,
       {R('median_um * 1000')} AS median_nm FROM positive""")
def group_mean_curve_summary(t):
    mean = with_grid(replicate_curves(t).groupBy("condition", "bin").agg(F.avg("intra").alias("intra")))
    s = cv.positive_summary(mean, ["condition"], "intra")
    s = s.withColumns({"mode_nm": F.col("peak_um") * 1000, "mean_nm": F.col("mean_um") * 1000, "median_nm": F.col("median_um") * 1000})
    return round_all(s, *POSITIVE_COLUMNS, "mode_nm", "mean_nm", "median_nm")


@query("replicate_normalized_bands", "CUR-5",
       f"""{REPL}, nrm AS (SELECT condition, br, bin,
           CASE WHEN abs(sum(intra) OVER w) > 2.220446049250313e-14 THEN intra / (sum(intra) OVER w) END AS area,
           CASE WHEN max(intra) OVER w > 0 THEN intra / (max(intra) OVER w) END AS peak
         FROM repl WINDOW w AS (PARTITION BY condition, br)),
       long AS (SELECT condition, bin, 'area_value' AS component, area AS value FROM nrm UNION ALL SELECT condition, bin, 'peak_value', peak FROM nrm),
       b AS (SELECT condition, component, bin, {BAND_SQL} FROM long GROUP BY ALL)
       SELECT condition, component, bin, n, {R_all(*BAND)} FROM b""")
def replicate_normalized_bands(t):
    keys = ["condition", "br"]
    r = cv.peak_normalized(cv.area_normalized(replicate_curves(t), keys, "intra", 1.0), keys, "intra")
    return round_all(hi.equal_replicate_band(r, ["condition"], ["area_value", "peak_value"]), *BAND)


@query("curve_area_peak_normalized", "CUR-3 CUR-4 CUR-10 WIN-11",
       f"""WITH {CURVES} SELECT cell, bin, {R(f'value / nullif(sum(value * {W64}) OVER w, 0)', 6)} AS area_value,
       {R('CASE WHEN max(value) OVER w > 0 THEN value / (max(value) OVER w) END')} AS peak_value
       FROM curves WINDOW w AS (PARTITION BY cell)""")
def curve_area_peak_normalized(t):
    c = cv.peak_normalized(cv.area_normalized(t.curves, ["cell"], "value", W64), ["cell"], "value")
    return c.select("cell", "bin", rounded(F.col("area_value"), 6).alias("area_value"), rounded(F.col("peak_value")).alias("peak_value"))


@query("leave_one_out_similarity", "CUR-9 WIN-5",
       f"""WITH {CURVES}, n AS (SELECT cell, br, bin, CASE WHEN max(value) OVER (PARTITION BY cell) > 0
             THEN value / (max(value) OVER (PARTITION BY cell)) END AS v FROM curves),
       o AS (SELECT *, (sum(v) OVER w - v) / nullif(count(v) OVER w - 1, 0) AS ref FROM n WINDOW w AS (PARTITION BY br, bin))
       SELECT br, cell, count(*) AS bins, {R('corr(v, ref)')} AS pearson_r, {R('sqrt(avg((v - ref) * (v - ref)))')} AS rmse
       FROM o WHERE (bin + 0.5) / 64.0 <= 0.5 AND v IS NOT NULL AND ref IS NOT NULL GROUP BY br, cell""")
def leave_one_out_similarity(t):
    c = cv.peak_normalized(t.curves, ["cell"], "value").withColumn("mid_um", (F.col("bin") + 0.5) / 64.0)
    return round_all(cv.leave_one_out_similarity(c, ["br"], "cell", "peak_value"), "pearson_r", "rmse")


def grouped(t):
    """Two-group curves: the first half of the vector is On, the second Not-on."""
    return t.curves.select(
        "cell", F.when(F.col("bin") < 32, "On").otherwise("Not-on").alias("grp"), (F.col("bin") % 32).alias("bin"), "value")


def states(t):
    status = F.when(F.col("toxic").isNull(), "pending").when(F.col("toxic") == 1, "failed").otherwise("complete")
    inv = t.raw("embeddings").join(t.raw("labels"), F.col("vec_id") == F.col("doc_id"), "left").select(
        F.col("vec_id").alias("cell"), F.col("label").alias("br"), (F.col("label") % 3).alias("condition"), status.alias("status"))
    return hi.cell_states(inv, grouped(t), groups=GROUPS, n_bins=32, width=1 / 32)


STATES = f"""WITH {CURVES}, g AS (SELECT cell, CASE WHEN bin < 32 THEN 'On' ELSE 'Not-on' END AS grp, bin % 32 AS bin, value FROM curves),
inv AS (SELECT vec_id AS cell, label AS br, label % 3 AS condition,
        CASE WHEN toxic IS NULL THEN 'pending' WHEN toxic = 1 THEN 'failed' ELSE 'complete' END AS status
        FROM embeddings LEFT JOIN labels ON vec_id = doc_id),
jg AS (SELECT cell, grp, count(*) AS bins, sum(value * 0.03125) AS area, max(value) AS top FROM g GROUP BY ALL),
j AS (SELECT cell, bool_and(abs(area) > 0.01 AND top > 0) AS good,
      list_sort(list_concat(list(grp || ':near_zero_signed_area') FILTER (abs(area) <= 0.01),
                list(grp || ':no_positive_peak') FILTER (top <= 0))) AS why FROM jg GROUP BY cell),
states AS (SELECT inv.cell, br, condition, status, status = 'complete' AND good AS included,
  CASE WHEN status = 'complete' THEN coalesce(array_to_string(why, ';'), '')
       WHEN status = 'pending' THEN 'not_completed' ELSE status END AS reasons FROM inv LEFT JOIN j USING (cell))
"""


@query("curve_eligibility", "PRJ-31 AGG-41",
       f"""{STATES} SELECT condition, br, cell, status, CASE WHEN included THEN 'member' ELSE 'exclusion' END AS role, reasons FROM states""")
def curve_eligibility(t):
    return hi.node_members(states(t))


@query("node_progress", "AGG-40",
       f"""{STATES}, n AS (SELECT condition, br, grouping(condition, br) AS depth, count(*) AS expected,
          count(*) FILTER (status = 'complete') AS completed, count(*) FILTER (status = 'failed') AS failed,
          count(*) FILTER (included) AS included, count(DISTINCT (condition, br)) AS expected_brs,
          count(DISTINCT (condition, br)) FILTER (included) AS brs_with_cells
          FROM (SELECT cell, condition, br, status, included FROM states) GROUP BY GROUPING SETS ((condition, br), (condition), ()))
       SELECT CASE depth WHEN 0 THEN 'BR' WHEN 1 THEN 'condition' ELSE 'comparison' END AS level, condition, br, expected, completed, failed,
         completed + failed AS terminal, included,
         CASE depth WHEN 0 THEN 1 WHEN 1 THEN (SELECT count(DISTINCT br) FROM states s WHERE s.condition = n.condition)
              ELSE (SELECT count(DISTINCT br) FROM states) END AS expected_brs,
         CASE depth WHEN 0 THEN CAST(included > 0 AS INTEGER) WHEN 1 THEN (SELECT count(DISTINCT br) FROM states s WHERE s.condition = n.condition AND included)
              ELSE (SELECT count(DISTINCT br) FROM states s WHERE included) END AS brs_with_cells,
         CASE WHEN completed + failed < expected THEN 'PROGRESS' WHEN failed > 0 OR included < completed
              THEN 'COMPLETE_WITH_FAILURES_OR_EXCLUSIONS' ELSE 'COMPLETE' END AS status FROM n""")
def node_progress(t):
    return hi.node_progress(states(t))


@query("summary_curves", "AGG-39 SNK-7",
       f"""{STATES},
    u AS (SELECT condition, br, grp, bin, value, value / (sum(value * 0.03125) OVER w) AS area, value / (max(value) OVER w) AS peak
          FROM g JOIN states USING (cell) WHERE included WINDOW w AS (PARTITION BY g.cell, grp)),
    b AS (SELECT condition, br, grp, bin, avg(value) AS signed, avg(area) AS area, avg(peak) AS peak, count(*) AS n FROM u GROUP BY ALL),
    ok AS (SELECT condition, br FROM (SELECT condition, br, grp, sum(signed * 0.03125) AS a, max(signed) AS m FROM b GROUP BY ALL)
           GROUP BY condition, br HAVING count(*) = 2 AND bool_and(abs(a) > 0.01 AND m > 0)),
    r AS (SELECT condition, br, grp, bin, signed, area, signed / (max(signed) OVER (PARTITION BY condition, br, grp)) AS peak
          FROM b SEMI JOIN ok USING (condition, br)),
    bl AS (SELECT 'BR' AS level, condition, br, grp, view, bin, v AS mean, NULL AS sd, NULL AS sem, n
           FROM (UNPIVOT b ON signed, area, peak INTO NAME view VALUE v)),
    cl AS (SELECT condition, grp, view, bin, avg(v) AS mean, stddev_samp(v) AS sd, stddev_samp(v) / sqrt(count(v)) AS sem, count(v) AS n
           FROM (UNPIVOT r ON signed, area, peak INTO NAME view VALUE v) GROUP BY ALL)
    SELECT level, condition, br, grp, view, bin, {R('mean', 6)} AS mean, {R('sd', 6)} AS sd, {R('sem', 6)} AS sem, n FROM bl
    UNION ALL SELECT l.level, condition, NULL, grp, view, bin, {R('mean', 6)}, {R('sd', 6)}, {R('sem', 6)}, n
    FROM cl CROSS JOIN (VALUES ('condition'), ('comparison')) l(level)""")
def summary_curves(t):
    s = hi.hierarchy_curves(states(t), grouped(t), groups=GROUPS, n_bins=32, width=1 / 32)
    return stored(s.withColumns({c: rounded(F.col(c), 6) for c in ("mean", "sd", "sem")}))


@query("curve_grid_mismatches", "PRJ-29",
       f"""{REPL} SELECT bin, count(DISTINCT CASE WHEN br % 5 = 3 AND bin % 7 = 2 THEN left_um + 0.01 ELSE left_um END) AS left_um_values,
         count(DISTINCT CASE WHEN br % 5 = 1 AND bin % 11 = 4 THEN right_um - 0.02 ELSE right_um END) AS right_um_values FROM repl GROUP BY bin HAVING bin % 7 = 2 OR bin % 11 = 4""")
def curve_grid_mismatches(t):
    """Some replicates come on a shifted grid in some bins; exactly those bins are reported."""
    moved = replicate_curves(t).withColumns({
        "left_um": F.when((F.col("br") % 5 == 3) & (F.col("bin") % 7 == 2), F.col("left_um") + 0.01).otherwise(F.col("left_um")),
        "right_um": F.when((F.col("br") % 5 == 1) & (F.col("bin") % 11 == 4), F.col("right_um") - 0.02).otherwise(F.col("right_um"))})
    return hi.grid_mismatches(moved)


@query("replicate_compatibility", "PRJ-30",
       f"""{REPL}, f AS (SELECT condition, br, count(*) AS bins, {R('min(left_um)')} AS lo, {R('max(right_um)')} AS hi,
         md5(string_agg(CAST({R('total', 6)} AS DECIMAL(20,6)), ',' ORDER BY bin)) AS digest FROM repl GROUP BY ALL)
       SELECT condition, count(*) AS replicates, count(DISTINCT br) AS distinct_ids, count(DISTINCT digest) AS distinct_inputs,
       count(DISTINCT bins) AS bin_counts, count(DISTINCT (lo, hi)) AS ranges FROM f GROUP BY condition""")
def replicate_compatibility(t):
    from stipple.operators.checks import replicate_compatibility as check

    return check(replicate_curves(t), ["condition"], "br", "total")


@query("summary_version_differences", "JOIN-34 SET-5",
       f"""{STATES}, o AS (SELECT condition, br, cell FROM states WHERE included), n AS (SELECT condition, br, cell FROM states WHERE status = 'complete')
       SELECT *, 'old' AS only_in FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n)
       UNION ALL SELECT *, 'new' FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o)""")
def summary_version_differences(t):
    s = states(t)
    return hi.version_differences(
        s.where("included").select("condition", "br", "cell"), s.where("status = 'complete'").select("condition", "br", "cell"))


@query("saved_curve_round_trip", "SRC-8 SRC-9 SRC-12 SNK-10",
       f"""{STATES}, c AS (SELECT condition, grp, cell, count(*) AS bins, {R('sum(value)')} AS mass, bool_and((bin + 1) / 32.0 > bin / 32.0) AS increasing
         FROM g JOIN inv USING (cell) GROUP BY ALL) SELECT condition, grp, cell, bins, mass, increasing, bins = 32 AND increasing AS valid FROM c""")
def saved_curve_round_trip(t):
    from stipple.sources.tables import check_saved_curves, read_curve_tables, scratch_folder, write_curve_tables

    c = grouped(t).join(t.curves.select("cell", "condition").distinct(), "cell")
    c = c.withColumns({"left_um": F.col("bin") / 32.0, "right_um": (F.col("bin") + 1) / 32.0})
    folder = scratch_folder(t.spark)
    write_curve_tables(c, folder, by=["condition", "grp"])
    saved = read_curve_tables(t.spark, folder, value_columns=["value"], id_columns={"cell": "bigint"}, by={"condition": "int", "grp": "string"})
    return check_saved_curves(saved, ["condition", "grp", "cell"], "value", n_bins=32)
