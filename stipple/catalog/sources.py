"""Scans, manifests, folder inventories, multi-lag displacement and the public split."""

from __future__ import annotations

from pyspark.sql import functions as F

from stipple.catalog.displacement import round_all
from stipple.catalog.registry import INVENTORY, POINTS, R, query
from stipple.functions.columns import rounded, safe_key
from stipple.operators import points as pt
from stipple.sources import readers as rd
from stipple.sources.tables import scratch_folder, write_csv

PT = f"WITH {POINTS}"


@query("localization_csv_scan", "SRC-1 SRC-2 SNK-10",
       f"""{PT} SELECT sample_id, count(*) AS rows_n, count(DISTINCT uid) AS uids, {R('sum(x_px)', 6)} AS sum_x, {R('sum(x_se_nm)', 6)} AS sum_se, count(*) FILTER (qc) AS ok FROM points GROUP BY 1""")
def localization_csv_scan(t):
    folder = scratch_folder(t.spark)
    names = [c.split()[0] for c in rd.LOCALIZATION_SCHEMA.split(",")]
    write_csv(t.points.select(*names), folder, compression="gzip")
    back = rd.read_localizations(t.spark, folder)
    return back.groupBy("sample_id").agg(
        F.count("*").alias("rows_n"), F.countDistinct("uid").alias("uids"), rounded(F.sum("x_px"), 6).alias("sum_x"),
        rounded(F.sum("x_se_nm"), 6).alias("sum_se"), F.count_if("qc").alias("ok"))


@query("localization_parquet_store", "SRT-1 SNK-1",
       f"""{PT} SELECT sample_id, count(*) AS rows_n, {R('sum(y_px)', 6)} AS sum_y FROM points WHERE sample_id < 10 AND frame BETWEEN 50 AND 150 GROUP BY 1""")
def localization_parquet_store(t):
    folder = scratch_folder(t.spark)
    rd.to_parquet(t.points.select("uid", "sample_id", "frame", "x_px", "y_px"), folder)
    stored = t.spark.read.parquet(folder).where("sample_id < 10 and frame between 50 and 150")
    return stored.groupBy(F.col("sample_id").cast("bigint").alias("sample_id")).agg(F.count("*").alias("rows_n"), rounded(F.sum("y_px"), 6).alias("sum_y"))


@query("manifest_rows", "SRC-3 SRC-4 PRJ-6 PRJ-17",
       f"""WITH {INVENTORY} SELECT condition AS condition_id, 'UNASSIGNED' AS genotype_id, CASE WHEN sample_id % 2 = 0 THEN 'nm' ELSE 'm' END AS coordinate_unit,
       count(*) AS cells, count(*) FILTER (sample_id % 3 <> 1) AS enabled_cells, count(*) FILTER (sample_id % 5 = 0) AS relative_paths FROM inventory WHERE sample_id IS NOT NULL GROUP BY ALL""")
def manifest_rows(t):
    folder = scratch_folder(t.spark)
    s = F.col("sample_id")
    flag = F.when(s % 3 == 0, "YES").when(s % 3 == 1, "no").otherwise(F.lit(None))
    m = t.inventory.where("sample_id is not null").select(
        F.col("condition").alias("condition_id"), F.lit("T").alias("target_id"), F.col("br").cast("string").alias("replicate_id"), s.cast("string").alias("cell_id"),
        F.concat(F.when(s % 5 == 0, "").otherwise("/data/"), s.cast("string"), F.lit(".mat")).alias("input_file"),
        F.lit("").alias("genotype_id"), F.when(s % 2 == 0, "nm").alias("coordinate_unit"), flag.alias("enabled"))
    write_csv(m, folder)
    rows, _ = rd.read_manifest(t.spark, folder)
    rows = rd.resolve_paths(rows, "/manifests")
    return rows.groupBy("condition_id", "genotype_id", "coordinate_unit").agg(
        F.count("*").alias("cells"), F.count_if("enabled").alias("enabled_cells"), F.count_if(F.col("input_file").startswith("/manifests/")).alias("relative_paths"))


@query("manifest_duplicate_keys", "SRC-3",
       """SELECT CAST(n_regionkey AS VARCHAR) AS condition_id, 'T' AS target_id, CAST(n_regionkey % 2 AS VARCHAR) AS replicate_id, n_name AS cell_id, count(*) AS n
       FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL HAVING count(*) > 1""")
def manifest_duplicate_keys(t):
    folder = scratch_folder(t.spark)
    j = t.raw("nation").join(t.raw("supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    m = j.select(F.col("n_regionkey").cast("string").alias("condition_id"), F.lit("T").alias("target_id"), (F.col("n_regionkey") % 2).cast("string").alias("replicate_id"),
                 F.col("n_name").alias("cell_id"), F.col("s_name").alias("input_file"))
    write_csv(m, folder)
    return rd.read_manifest(t.spark, folder)[1]


URL = r"^https?://([^/]+)/([^/?#]+)/(\d+)"
PARTS = r"""parts AS (SELECT page_id, url AS path, nullif(regexp_extract(url, '^https?://([^/]+)/([^/?#]+)/(\d+)', 1), '') AS host,
  nullif(regexp_extract(url, '^https?://([^/]+)/([^/?#]+)/(\d+)', 2), '') AS lang, nullif(regexp_extract(url, '^https?://([^/]+)/([^/?#]+)/(\d+)', 3), '') AS num FROM pages)"""


def parts(t):
    return rd.path_parts(t.folders, URL, ["host", "lang", "num"])


@query("input_groups", "SRC-5", f"WITH {PARTS} SELECT host, lang, count(*) AS files, min(path) AS first_path FROM parts WHERE host IS NOT NULL GROUP BY ALL")
def input_groups(t):
    return rd.input_groups(parts(t), ["host", "lang"])


@query("sample_inventory", "SRC-6",
       f"""WITH {PARTS} SELECT host, lang, count(*) FILTER (path LIKE '%?%') AS query_files, count(*) FILTER (path LIKE '%#%') AS anchor_files,
       CAST(min(try_strptime(substr(lpad(num, 6, '0'), 1, 6), '%m%d%y')) AS DATE) AS acquired, count(*) FILTER (path LIKE '%?%') = 1 AND count(*) FILTER (path LIKE '%#%') = 1 AS complete
       FROM parts WHERE host IS NOT NULL GROUP BY ALL""")
def sample_inventory(t):
    p = parts(t).where("host is not null").withColumn("stamp", F.lpad("num", 6, "0"))
    return rd.sample_inventory(p, ["host", "lang"], {"query": F.col("path").contains("?"), "anchor": F.col("path").contains("#")}, date_text="stamp")


@query("replicate_inventory", "SRC-7 PRJ-32",
       f"""WITH {PARTS} SELECT lang AS condition, CAST(num AS INTEGER) % 4 AS br, count(DISTINCT regexp_replace(host, '[^A-Za-z0-9_.-]', '_', 'g')) AS folders, count(DISTINCT num) AS cells,
       count(DISTINCT regexp_replace(host, '[^A-Za-z0-9_.-]', '_', 'g')) > 1 AS conflict FROM parts WHERE host IS NOT NULL GROUP BY ALL""")
def replicate_inventory(t):
    p = parts(t).where("host is not null").select(
        F.col("lang").alias("condition"), (F.col("num").cast("int") % 4).alias("br"), safe_key(F.col("host")).alias("folder"), "num")
    return rd.replicate_inventory(p, ["condition", "br"], "folder", "num")


@query("base_records", "SRC-10",
       """WITH r AS (SELECT conv_id AS file, role || CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN '_TracksFiltered' ELSE '_SpotsMaskFiltered' END AS name FROM conversations),
       b AS (SELECT * FROM r WHERE NOT regexp_matches(name, '(_SpotsMaskFiltered|_TracksFiltered)$'))
       SELECT file, name, count(*) AS n FROM b GROUP BY ALL HAVING count(*) > 1""")
def base_records(t):
    suffix = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, "_TracksFiltered").otherwise("_SpotsMaskFiltered")
    r = t.raw("conversations").select(F.col("conv_id").alias("file"), F.concat("role", suffix).alias("name"))
    return rd.base_records(r, file="file", name="name")[1]


@query("time_grid_check", "PRJ-3 PRJ-4",
       f"""{PT} SELECT sample_id, count(*) AS rows_n, count(*) FILTER (frame % 50 <> 3) AS on_grid, count(*) FILTER (frame % 60 = 0) AS interval_mismatches FROM points GROUP BY 1""")
def time_grid_check(t):
    off = F.when(F.col("frame") % 50 == 3, 0.007).otherwise(0.0)
    p = t.points.select("sample_id", F.col("frame").alias("f"), (F.col("frame") * 0.02 + off).alias("time_s"),
                        F.when(F.col("frame") % 60 == 0, 0.021).otherwise(0.02).alias("frame_interval"))
    p = rd.time_to_frame(p, time="time_s", interval=0.02)
    bad = rd.interval_mismatches(p, interval=0.02).groupBy("sample_id").agg(F.count("*").alias("interval_mismatches"))
    good = p.groupBy("sample_id").agg(F.count("*").alias("rows_n"), F.count_if(F.col("frame") == F.col("f")).alias("on_grid"))
    return good.join(bad, "sample_id", "left").na.fill(0, ["interval_mismatches"])


@query("candidate_index", "WIN-7",
       f"{PT} SELECT uid, sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY frame, x_um, y_um, uid) - 1 AS candidate_index FROM points")
def candidate_index(t):
    return pt.candidate_index(t.points.select("uid", "sample_id", "frame", "x_um", "y_um")).select("uid", "sample_id", "candidate_index")


@query("public_detection_table", "WIN-9 PRJ-20",
       f"""{PT} SELECT row_number() OVER (ORDER BY frame, md5('11:' || frame || ':' || uid)) - 1 AS detection_id, frame, {R('x_um')} AS x_um, {R('y_um')} AS y_um FROM selected""")
def public_detection_table(t):
    shuffled = pt.shuffled_ids(t.points.where("qc").select("uid", "frame", "x_um", "y_um", "qc"), seed=11)
    public, _ = pt.public_split(shuffled, "qc", ["detection_id", "frame", "x_um", "y_um"])
    return round_all(public, "x_um", "y_um")


@query("hidden_truth_table", "PRJ-20",
       f"""{PT} SELECT row_number() OVER (ORDER BY frame, md5('11:' || frame || ':' || uid)) - 1 AS detection_id, uid, qc FROM selected""")
def hidden_truth_table(t):
    shuffled = pt.shuffled_ids(t.points.where("qc").select("uid", "frame", "x_um", "y_um", "qc"), seed=11)
    return pt.public_split(shuffled, "qc", ["detection_id", "frame", "x_um", "y_um"])[1]


@query("detection_table_violations", "PRJ-21",
       f"""{PT} SELECT "check", count(*) AS rows_n, CASE "check" WHEN 'frame_in_range' THEN count(*) FILTER (frame > 350) ELSE 0 END AS violations
       FROM points CROSS JOIN (VALUES ('frame_in_range'), ('time_matches_frame'), ('finite_position')) c("check") GROUP BY "check" """)
def detection_table_violations(t):
    from stipple.functions.columns import close, finite
    from stipple.operators.checks import violation_counts

    p = t.points.withColumn("time_s", F.col("frame") * F.lit(0.02))
    return violation_counts(p, [
        ("frame_in_range", F.col("frame").between(0, 350)), ("time_matches_frame", close(F.col("time_s"), F.col("frame") * F.lit(0.02), 1e-9)),
        ("finite_position", finite(F.col("x_um")) & finite(F.col("y_um")))])


@query("rectangular_window", "PRJ-18 PRJ-22", f"{PT} SELECT sample_id, frame, count(*) AS n FROM points WHERE x_um BETWEEN 1.2 AND 1.8 AND y_um BETWEEN 0.5 AND 2.0 GROUP BY ALL")
def rectangular_window(t):
    return pt.in_rectangle(t.points, (1.2, 1.8), (0.5, 2.0)).groupBy("sample_id", "frame").agg(F.count("*").alias("n"))


@query("axial_slab", "PRJ-19", "SELECT l_suppkey AS sample_id, count(*) AS n FROM lineitem WHERE l_tax BETWEEN CAST(0.02 AS DOUBLE) AND CAST(0.05 AS DOUBLE) GROUP BY 1")
def axial_slab(t):
    z = t.raw("lineitem").select(F.col("l_suppkey").alias("sample_id"), F.col("l_tax").alias("z_um"))
    return pt.axial_slab(z, 0.02, 0.05).groupBy("sample_id").agg(F.count("*").alias("n"))


TRACK = "tr AS (SELECT user_id, CAST(epoch_ms(ts) // 86400000 - 19723 AS INTEGER) AS frame, avg(value) AS x, max(value) AS y FROM events GROUP BY ALL)"


def tracks(t):
    day = F.datediff("ts", F.lit("2024-01-01")).alias("frame")
    return t.raw("events").groupBy("user_id", day).agg(F.avg("value").alias("x"), F.max("value").alias("y"))


@query("multi_lag_displacement", "WIN-8",
       f"""WITH {TRACK} SELECT CAST(lag AS INTEGER) AS lag, count(*) AS pairs, {R('avg(abs(b.x - a.x))')} AS mean_abs_x, {R('avg(abs(b.y - a.y))')} AS mean_abs_y,
       {R('avg(abs(b.x - a.x)) / avg(abs(b.y - a.y))')} AS axis_ratio FROM tr a CROSS JOIN (VALUES (1), (2), (3), (5), (8), (12), (20)) l(lag) JOIN tr b ON a.user_id = b.user_id AND b.frame = a.frame + lag GROUP BY 1""")
def multi_lag_displacement(t):
    d = pt.lag_displacement(tracks(t), [1, 2, 3, 5, 8, 12, 20], particle="user_id", x="x", y="y")
    return round_all(d, "mean_abs_x", "mean_abs_y", "axis_ratio")


@query("particle_axis_ranges", "WIN-8", f"WITH {TRACK} SELECT user_id, {R('max(x) - min(x)')} AS x_range, {R('max(y) - min(y)')} AS y_range FROM tr GROUP BY 1")
def particle_axis_ranges(t):
    return round_all(pt.axis_ranges(tracks(t), particle="user_id", x="x", y="y"), "x_range", "y_range")


@query("table_fingerprint", "AGG-55",
       """WITH h AS (SELECT CAST('0x' || substr(md5(concat_ws('|', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment)), 1, 12) AS BIGINT) AS h FROM customer)
       SELECT count(*) AS rows_n, CAST(sum(h) AS VARCHAR) AS digest_sum, bit_xor(h) AS digest_xor FROM h""")
def table_fingerprint(t):
    from stipple.operators.checks import table_digest

    return table_digest(t.raw("customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]).withColumn("digest_sum", F.col("digest_sum").cast("string"))
