"""Scalar cell metrics, inventories and distribution statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from stipple.catalog.displacement import R_all, round_all
from stipple.catalog.registry import INVENTORY, METRICS, POINTS, R, query, sql_bin
from stipple.functions.columns import rounded
from stipple.operators import checks as ck
from stipple.operators import distribution as ds
from stipple.operators import hierarchy as hi
from stipple.operators import metrics as mt
from stipple.sources.tables import stored

M = f"WITH {METRICS}"
C4 = ('"on"', "not_on", "unknown", "qc_excluded")
VALUES = ["on_pct", "area", "first_area"]


@query("cell_metric_records", "AGG-31 PRJ-25", f"""{M} SELECT cell, br, condition, protein, "on", not_on, unknown, qc_excluded, selected, roi_candidates,
       {R('on_pct')} AS on_pct, {R('area', 6)} AS area, first_area FROM cell_metrics""")
def cell_metric_records(t):
    return t.cell_metrics.withColumns({"on_pct": rounded(F.col("on_pct")), "area": rounded(F.col("area"), 6)})


@query("two_level_metrics", "AGG-37 AGG-20",
       f"""{M}, l AS (SELECT condition, br, metric, value FROM (SELECT condition, br, 'on_pct' AS metric, on_pct AS value FROM cell_metrics
         UNION ALL SELECT condition, br, 'area', area FROM cell_metrics UNION ALL SELECT condition, br, 'first_area', first_area FROM cell_metrics)),
       b AS (SELECT condition, br, metric, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, stddev_samp(value) / sqrt(count(value)) AS sem FROM l GROUP BY ALL)
       SELECT 'BR' AS level, condition, br, metric, n, {R('mean', 5)} AS mean, {R('sd', 5)} AS sd, {R('sem', 5)} AS sem, n AS n_cells FROM b
       UNION ALL SELECT 'condition', condition, NULL, metric, count(*), {R('avg(mean)', 5)}, {R('stddev_samp(mean)', 5)},
         {R('stddev_samp(mean) / sqrt(count(mean))', 5)}, CAST(sum(n) AS BIGINT) FROM b WHERE n > 0 GROUP BY condition, metric""")
def two_level_metrics(t):
    m = hi.two_level_metrics(t.cell_metrics, VALUES)
    return m.withColumns({c: rounded(F.col(c), 5) for c in ("mean", "sd", "sem")})


@query("comparison_counts", "AGG-38",
       f"""{M}, l AS (SELECT condition, br, metric, value FROM (SELECT condition, br, 'on_pct' AS metric, on_pct AS value FROM cell_metrics
         UNION ALL SELECT condition, br, 'area', area FROM cell_metrics UNION ALL SELECT condition, br, 'first_area', first_area FROM cell_metrics))
       SELECT metric, count(value) AS valid_cells, count(DISTINCT (condition, br)) FILTER (value IS NOT NULL) AS valid_brs,
         count(DISTINCT condition) FILTER (value IS NOT NULL) AS valid_conditions FROM l GROUP BY 1""")
def comparison_counts(t):
    return hi.comparison_counts(t.cell_metrics, VALUES)


ALL6 = ('"on"', "not_on", "unknown", "qc_excluded", "selected", "roi_candidates")


@query("grouped_count_sums", "AGG-42 AGG-43",
       f"""{M} SELECT condition, br, protein, grouping(br) AS is_condition, count(*) AS cells, count(roi_candidates) AS cells_with_counts,
       {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ALL6)},
       {', '.join(R(f'sum({c}) / CAST(nullif(count(roi_candidates), 0) AS DOUBLE)') + ' AS ' + c.strip(chr(34)) + '_per_cell' for c in ALL6)}
       FROM cell_metrics GROUP BY GROUPING SETS ((condition, br, protein), (condition, protein))""")
def grouped_count_sums(t):
    g = mt.grouped_counts(t.cell_metrics)
    return round_all(g, *[c for c in g.columns if c.endswith("_per_cell")])


@query("count_means_three_ways", "AGG-44",
       f"""{M}, b AS (SELECT condition, br, protein, count(*) AS cells, avg(selected) AS selected, avg("on") AS "on", avg(not_on) AS not_on,
         sum(selected) AS s1, sum("on") AS s2, sum(not_on) AS s3 FROM cell_metrics WHERE selected IS NOT NULL GROUP BY ALL)
       SELECT condition, br, protein, 'cell_mean_within_BR' AS averaging, cells, 1 AS replicates, {R_all('selected')}, {R('"on"')} AS "on", {R_all('not_on')} FROM b
       UNION ALL SELECT condition, NULL, protein, 'all_cell_mean', CAST(sum(cells) AS BIGINT), count(*), {R('sum(s1) / sum(cells)')}, {R('sum(s2) / sum(cells)')}, {R('sum(s3) / sum(cells)')} FROM b GROUP BY condition, protein
       UNION ALL SELECT condition, NULL, protein, 'equal_replica_mean', CAST(sum(cells) AS BIGINT), count(*), {R('avg(selected)')}, {R('avg("on")')}, {R('avg(not_on)')} FROM b GROUP BY condition, protein""")
def count_means_three_ways(t):
    return round_all(mt.count_means(t.cell_metrics, ["selected", "on", "not_on"]), "selected", "on", "not_on")


@query("endpoint_descriptives", "AGG-45",
       f"""{M}, l AS (SELECT protein, condition, br, endpoint, value FROM (SELECT protein, condition, br, 'on_pct' AS endpoint, on_pct AS value FROM cell_metrics
         UNION ALL SELECT protein, condition, br, 'area', area FROM cell_metrics)),
       b AS (SELECT protein, condition, br, endpoint, count(value) AS n, count(*) AS av, avg(value) AS m, sum(value) AS s FROM l GROUP BY ALL)
       SELECT protein, condition, endpoint, count(m) AS n_br, CAST(sum(n) AS BIGINT) AS n_cells, CAST(sum(av) AS BIGINT) AS n_cells_available, {R('avg(m)', 5)} AS mean,
         {R('stddev_samp(m)', 5)} AS sd, {R('stddev_samp(m) / sqrt(count(m))', 5)} AS sem, {R('sum(s) / sum(n)', 5)} AS pooled_cell_mean FROM b GROUP BY ALL""")
def endpoint_descriptives(t):
    e = mt.endpoint_descriptives(t.cell_metrics, ["on_pct", "area"])
    return e.withColumns({c: rounded(F.col(c), 5) for c in ("mean", "sd", "sem", "pooled_cell_mean")})


@query("ratio_estimator_audit", "AGG-46",
       f"""{M}, b AS (SELECT protein, condition, br, count(*) AS n, sum("on") AS o, sum(not_on) AS x, avg(on_pct) AS m, sum(on_pct) AS s, count(on_pct) AS k FROM cell_metrics GROUP BY ALL)
       SELECT protein, condition, CAST(sum(n) AS BIGINT) AS n_cells, count(*) AS n_br, {R('sum(s) / sum(k)')} AS mean_of_cell_ratios,
         {R('sum(o) * 100.0 / sum(o + x)')} AS pooled_ratio, {R('avg(m)')} AS equal_br_mean_of_ratios FROM b GROUP BY ALL""")
def ratio_estimator_audit(t):
    return round_all(mt.ratio_audit(t.cell_metrics), "mean_of_cell_ratios", "pooled_ratio", "equal_br_mean_of_ratios")


@query("count_failures", "PRJ-23 SNK-8",
       f"""{M}, s AS (SELECT cell, br, condition, CASE WHEN cell % 17 = 5 THEN NULL ELSE "on" END AS o, not_on AS n, unknown AS u, qc_excluded AS q,
         CASE WHEN cell % 10 = 3 THEN selected + 1 ELSE selected END AS s, CASE WHEN cell % 19 = 4 THEN NULL ELSE roi_candidates END AS r, on_pct AS p FROM cell_metrics),
       v AS (SELECT *, o IS NULL OR n IS NULL OR u IS NULL AS a, coalesce(o + n + u <> s, true) AS b, coalesce(s + q <> r, true) AS c,
         coalesce(CASE WHEN p IS NULL THEN o + n <> 0 ELSE o + n = 0 OR abs(p - o * 100.0 / nullif(o + n, 0)) > CAST(1e-6 AS DOUBLE) END, true) AS d FROM s)
       SELECT cell, br, condition, concat_ws(';', CASE WHEN a THEN 'counts_present' END, CASE WHEN b THEN 'selected_total' END,
         CASE WHEN c THEN 'candidate_total' END, CASE WHEN d THEN 'percentage_agrees' END) AS message FROM v WHERE a OR b OR c OR d""")
def count_failures(t):
    """Saved text with faults of several kinds: a fraction, a wrong total, a negative count."""
    cell = F.col("cell")
    text = t.cell_metrics.withColumns({c: F.col(c).cast("string") for c in mt.COUNTS}).withColumns({
        "on": F.when(cell % 17 == 5, F.concat("on", F.lit(".5"))).otherwise(F.col("on")),
        "selected": F.when(cell % 10 == 3, (F.col("selected").cast("long") + 1).cast("string")).otherwise(F.col("selected")),
        "roi_candidates": F.when(cell % 19 == 4, F.concat(F.lit("-"), "roi_candidates")).otherwise(F.col("roi_candidates"))})
    saved = text.withColumns({c: mt.parse_count(F.col(c)) for c in mt.COUNTS})
    _, bad = ck.split_failures(saved, mt.count_expectations())
    return stored(bad.select("cell", "br", "condition", "message"))


@query("metric_validity", "PRJ-26",
       f"""{M} SELECT cell, metric, CASE metric WHEN 'on_pct' THEN on_pct IS NOT NULL WHEN 'area' THEN area IS NOT NULL ELSE first_area IS NOT NULL END AS valid,
         CASE WHEN CASE metric WHEN 'on_pct' THEN on_pct WHEN 'area' THEN area ELSE first_area END IS NULL THEN 'missing' ELSE '' END AS why
       FROM cell_metrics CROSS JOIN (VALUES ('on_pct'), ('area'), ('first_area')) v(metric)""")
def metric_validity(t):
    v = mt.metric_validity(t.cell_metrics, VALUES)
    return v.select("cell", F.explode("validity").alias("metric", "valid"), "why").select(
        "cell", "metric", "valid", F.array_join(F.element_at("why", F.col("metric")), ";").alias("why"))


@query("json_validity_map", "PRJ-26 SNK-10",
       """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract(props, '$.k') IS NOT NULL AS has_k FROM events""")
def json_validity_map(t):
    m = F.from_json("props", "map<string,int>")
    return t.raw("events").select("event_id", F.try_element_at(m, F.lit("k")).alias("k"), F.map_contains_key(m, "k").alias("has_k"))


SITES = "sites AS (SELECT c_custkey AS cell, c_nationkey AS br, n_regionkey AS condition FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def sites(t):
    return t.cell_metrics.select("cell", "br", "condition")


def finished(t):
    return t.raw("orders").groupBy(F.col("o_custkey").alias("cell")).agg(F.count("*").alias("orders_n"), F.max("o_totalprice").alias("top"))


@query("expected_inventory", "JOIN-23",
       f"""WITH {SITES}, f AS (SELECT o_custkey AS cell, count(*) AS orders_n, max(o_totalprice) AS top FROM orders GROUP BY 1)
       SELECT cell, br, condition, orders_n, top, CASE WHEN orders_n IS NULL THEN 'pending' ELSE 'complete' END AS status FROM sites LEFT JOIN f USING (cell)""")
def expected_inventory(t):
    return mt.expected_inventory(sites(t), finished(t), key="cell")


@query("unexpected_cells", "JOIN-24",
       f"""WITH {SITES}, s AS (SELECT * FROM sites WHERE condition <> 4), d AS (SELECT cell, br, CASE WHEN br = 7 THEN 9 ELSE condition END AS condition FROM sites)
       SELECT d.cell, d.br, d.condition, CASE WHEN s.cell IS NULL THEN 'not_expected' ELSE 'identity_differs' END AS problem
       FROM d LEFT JOIN s USING (cell) WHERE s.cell IS NULL OR s.br <> d.br OR s.condition <> d.condition""")
def unexpected_cells(t):
    done = sites(t).withColumn("condition", F.when(F.col("br") == 7, 9).otherwise(F.col("condition")))
    return mt.unexpected_cells(sites(t).where("condition <> 4"), done, key="cell", identity=["br", "condition"])


@query("completion_registry", "JOIN-25 SET-7",
       """WITH o AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL)
       SELECT conv_id AS sample_id, count(*) AS paths, count(DISTINCT role) AS digests, arg_min(role, turn) AS digest, min(turn) AS path,
         CASE WHEN count(DISTINCT role) > 1 THEN 'conflict' ELSE 'complete' END AS status FROM o GROUP BY 1""")
def completion_registry(t):
    c = t.completions
    return mt.merge_completions([c.where("path % 2 = 0"), c.where("path % 2 = 1"), c.where("path = 0")])


@query("source_count_conflicts", "JOIN-26",
       """WITH s AS (SELECT doc_id, quality AS v FROM labels UNION ALL SELECT doc_id, toxic FROM labels)
       SELECT doc_id, count(*) AS sources, count(DISTINCT v) AS versions FROM s GROUP BY 1 HAVING count(DISTINCT v) <> 1""")
def source_count_conflicts(t):
    l = t.raw("labels")
    s = l.select("doc_id", F.col("quality").alias("v")).unionByName(l.select("doc_id", F.col("toxic").alias("v")))
    return mt.source_agreement(s, key="doc_id", columns=["v"])


@query("cardinality_check", "JOIN-33",
       f"""{M}, e AS (SELECT n_regionkey AS condition, count(*) * 10 AS expected FROM nation GROUP BY 1), f AS (SELECT condition, count(*) AS found FROM cell_metrics WHERE protein = 'P1' GROUP BY 1)
       SELECT condition, coalesce(found, 0) AS found, expected, coalesce(found, 0) IS NOT DISTINCT FROM expected AS ok FROM f FULL JOIN e USING (condition)""")
def cardinality_check(t):
    expected = t.raw("nation").groupBy(F.col("n_regionkey").alias("condition")).agg((F.count("*") * 10).alias("expected"))
    return mt.cardinality_check(t.cell_metrics.where("protein = 'P1'"), expected, ["condition"])


@query("reader_condition_table", "SNK-12 SRT-3 SRT-5",
       f"""{M}, b AS (SELECT condition, br, avg(on_pct) AS p, avg(area) AS a, count(on_pct) AS np, count(area) AS na FROM cell_metrics GROUP BY ALL)
       SELECT r_name AS condition, 'BR' || br AS br, CAST(br AS INTEGER) AS br_order, CAST(CASE r_name WHEN 'ASIA' THEN 0 WHEN 'AFRICA' THEN 1 ELSE 2 END AS INTEGER) AS condition_order,
         {R('p / 100')} AS on_fraction, {R('a', 5)} AS area, CASE WHEN np <> na THEN 'valid n differs: on_pct ' || np || ', area ' || na ELSE '' END AS note
       FROM b JOIN region ON r_regionkey = condition""")
def reader_condition_table(t):
    from stipple.plans.reports import reader_table

    named = t.cell_metrics.join(t.raw("region"), F.col("condition") == F.col("r_regionkey")).withColumn("condition", F.col("r_name"))
    named = named.withColumn("br", F.concat(F.lit("BR"), F.col("br")))
    r = reader_table(named, preferred=["ASIA", "AFRICA"])
    return stored(r.withColumns({"on_fraction": rounded(F.col("on_fraction")), "area": rounded(F.col("area"), 5)}))


@query("batch_summary", "SNK-9",
       f"""WITH {INVENTORY}, {POINTS}, d AS (SELECT sample_id, count(*) AS points_n FROM points WHERE frame < 200 GROUP BY 1)
       SELECT condition, br, count(sample_id) AS cells, count(points_n) AS analyzed, CAST(coalesce(sum(points_n), 0) AS BIGINT) AS points_n,
         CASE WHEN count(sample_id) = 0 THEN 'pending' WHEN count(points_n) < count(sample_id) THEN 'partial' ELSE 'complete' END AS status
       FROM inventory LEFT JOIN d USING (sample_id) GROUP BY ALL""")
def batch_summary(t):
    from stipple.plans.reports import batch_summary as report

    done = t.points.where("frame < 200").groupBy("sample_id").agg(F.count("*").alias("points_n"))
    return stored(report(t.inventory, done))


HG = f"WITH {POINTS}"
AXES = ("x_se_nm", "y_se_nm")


@query("attribute_histogram", "AGG-1 AGG-25",
       f"""{HG} SELECT grp, {sql_bin('x_se_nm', 40, 200.0)} AS bin, count(*) AS n FROM selected WHERE x_se_nm BETWEEN 0 AND 200 GROUP BY ALL""")
def attribute_histogram(t):
    return ds.histogram(t.selected, ["grp"], "x_se_nm", lower=0.0, upper=200.0, n_bins=40)


@query("histogram_range_accounting", "AGG-25",
       f"""{HG} SELECT grp, count(*) AS total, count(*) FILTER (photons_e BETWEEN 10000 AND 60000) AS displayed, count(*) FILTER (photons_e < 10000) AS below,
       count(*) FILTER (photons_e > 60000) AS above, 0 AS nonfinite, true AS balanced FROM selected GROUP BY grp""")
def histogram_range_accounting(t):
    return ds.range_accounting(t.selected, ["grp"], "photons_e", lower=10000.0, upper=60000.0)


@query("data_edge_histogram", "AGG-26",
       f"""{HG}, m AS (SELECT sample_id, greatest(1.0, max(photons_e)) AS upper FROM selected GROUP BY 1),
       g AS (SELECT *, upper / 100 AS w, least(CAST(floor(photons_e / (upper / 100)) AS INTEGER), 99) AS i FROM selected JOIN m USING (sample_id))
       SELECT sample_id, grp, upper, CASE WHEN photons_e < i * w THEN i - 1 WHEN i < 99 AND photons_e >= (i + 1) * w THEN i + 1 ELSE i END AS bin, count(*) AS n FROM g GROUP BY ALL""")
def data_edge_histogram(t):
    return ds.data_edge_histogram(t.selected, ["sample_id"], "grp", "photons_e", n_bins=100)


@query("error_histogram_2d", "AGG-27",
       f"""{HG} SELECT grp, {sql_bin('x_se_nm', 40, 200.0)} AS bx, {sql_bin('y_se_nm', 40, 200.0)} AS by, count(*) AS n
       FROM selected WHERE x_se_nm BETWEEN 0 AND 200 AND y_se_nm BETWEEN 0 AND 200 GROUP BY ALL""")
def error_histogram_2d(t):
    return ds.histogram_2d(t.selected, ["grp"], "x_se_nm", "y_se_nm", lower=0.0, upper=200.0, n_bins=40)


@query("pooled_count_map", "AGG-28",
       f"""{HG} SELECT grp, CAST(floor((x_px - 0 + 0.5) * 4) AS INTEGER) AS mx, CAST(floor((y_px - 0 + 0.5) * 4) AS INTEGER) AS my, count(*) AS n FROM selected GROUP BY ALL""")
def pooled_count_map(t):
    return ds.count_map(t.selected, ["grp"], "x_px", "y_px", x0=0, y0=0)


@query("attribute_description", "AGG-29 SRT-6",
       f"""{HG}, h AS (SELECT sample_id, {sql_bin('y_se_nm', 40, 200.0)} AS bin, count(*) AS n FROM selected WHERE y_se_nm BETWEEN 0 AND 200 GROUP BY ALL),
       k AS (SELECT * FROM h QUALIFY n = max(n) OVER (PARTITION BY sample_id)),
       md AS (SELECT sample_id, CASE WHEN count(*) = 1 THEN (min(bin) + 0.5) * 5.0 END AS mode,
         CASE WHEN count(*) = 1 THEN 'unique_native_histogram_bin' ELSE 'unavailable_tied_or_empty_bins' END AS mode_status FROM k GROUP BY 1)
       SELECT sample_id, count(*) AS n, {R('avg(y_se_nm)')} AS mean, {R('quantile_cont(y_se_nm, 0.5)')} AS median, {R('any_value(mode)')} AS mode, any_value(mode_status) AS mode_status
       FROM selected JOIN md USING (sample_id) GROUP BY 1""")
def attribute_description(t):
    return round_all(ds.describe(t.selected, ["sample_id"], "y_se_nm", lower=0.0, upper=200.0, n_bins=40), "mean", "median", "mode")


@query("pooled_quantiles", "AGG-30",
       f"""{HG} SELECT grp, prob, {R('CASE prob WHEN 0.1 THEN quantile_cont(photons_e, 0.1) WHEN 0.5 THEN quantile_cont(photons_e, 0.5) ELSE quantile_cont(photons_e, 0.9) END')} AS quantile
       FROM selected CROSS JOIN (VALUES (CAST(0.1 AS DOUBLE)), (0.5), (0.9)) v(prob) GROUP BY grp, prob""")
def pooled_quantiles(t):
    from stipple.operators.skew import exact_quantiles

    return round_all(exact_quantiles(t.selected, ["grp"], "photons_e", [0.1, 0.5, 0.9]), "quantile")


@query("selection_digest", "AGG-54 AGG-55",
       f"""{HG}, h AS (SELECT sample_id, CAST('0x' || substr(md5(concat_ws('|', uid, CAST(frame AS VARCHAR), grp)), 1, 12) AS BIGINT) AS h FROM selected)
       SELECT sample_id, count(*) AS rows_n, CAST(sum(h) AS VARCHAR) AS digest_sum, bit_xor(h) AS digest_xor FROM h GROUP BY 1""")
def selection_digest(t):
    return ck.table_digest(t.selected, ["uid", "frame", "grp"], ["sample_id"]).withColumn("digest_sum", F.col("digest_sum").cast("string"))


@query("representative_frames", "SNK-13 SRT-4", f"{HG} SELECT uid, sample_id, frame, grp FROM selected WHERE frame IN (0, 100, 200, 300)")
def representative_frames(t):
    return stored(t.selected.where(F.col("frame").isin(0, 100, 200, 300)).select("uid", "sample_id", "frame", "grp"))


RT = f"""{M}, named AS (SELECT r_name AS condition, 'BR' || br AS br, CAST(br AS INTEGER) AS br_order, protein, cell, selected, "on", not_on, on_pct / 100 AS of, area,
   CAST(CASE r_name WHEN 'ASIA' THEN 0 WHEN 'AFRICA' THEN 1 ELSE 2 END AS INTEGER) AS condition_order FROM cell_metrics JOIN region ON r_regionkey = condition),
 b AS (SELECT condition_order, condition, br, br_order, protein, avg(of) AS of, avg(area) AS area, count(of) AS n_on, count(area) AS n_area, count(*) AS cells FROM named GROUP BY ALL)"""
NOTE = "CASE WHEN n_on <> n_area THEN 'valid n differs between metrics' ELSE '' END AS note"


def reader_table_set(t):
    from stipple.plans.reports import reader_tables

    named = t.cell_metrics.join(t.raw("region"), F.col("condition") == F.col("r_regionkey")).withColumn("condition", F.col("r_name"))
    return reader_tables(named.withColumn("br", F.concat(F.lit("BR"), F.col("br"))), preferred=["ASIA", "AFRICA"])


def tidy(df, *wide):
    return df.withColumns({c: rounded(F.col(c), 5 if c == "area" else 9) for c in wide})


@query("reader_br_summary", "SNK-12 SRT-3",
       f"{RT} SELECT condition_order, br_order, condition, br, protein, {R('of')} AS on_fraction, {R('area', 5)} AS area, n_on, n_area, cells, {NOTE} FROM b")
def reader_br_summary(t):
    return stored(tidy(reader_table_set(t)["br_summary"], "on_fraction", "area"))


@query("reader_condition_summary", "SNK-12",
       f"""{RT}, c AS (SELECT condition_order, condition, protein, avg(of) AS of, avg(area) AS area, CAST(sum(n_on) AS BIGINT) AS n_on, CAST(sum(n_area) AS BIGINT) AS n_area, count(*) AS replicates FROM b GROUP BY ALL)
       SELECT condition_order, condition, protein, {R('of')} AS on_fraction, {R('area', 5)} AS area, n_on, n_area, replicates, {NOTE} FROM c""")
def reader_condition_summary(t):
    return stored(tidy(reader_table_set(t)["condition_summary"], "on_fraction", "area"))


@query("reader_localization_means", "SNK-12",
       f"""{RT} SELECT condition_order, condition, br, protein, count(*) AS cells, {R('avg(selected)')} AS selected_mean, {R('avg("on")')} AS on_mean, {R('avg(not_on)')} AS not_on_mean
       FROM named WHERE selected IS NOT NULL GROUP BY ALL""")
def reader_localization_means(t):
    return stored(tidy(reader_table_set(t)["localization_means"], "selected_mean", "on_mean", "not_on_mean"))


@query("reader_cells", "SNK-12", f"""{RT} SELECT condition_order, br_order, condition, br, protein, cell, selected, "on", not_on, {R('of')} AS on_fraction, {R('area', 5)} AS area FROM named""")
def reader_cells(t):
    return stored(tidy(reader_table_set(t)["cells"], "on_fraction", "area"))
