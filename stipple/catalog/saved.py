"""Saved results of several layouts and ages, and the identity of replicate inputs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stipple.catalog.displacement import positive_sql, round_all
from stipple.catalog.registry import CURVES, R, query
from stipple.operators.curves import positive_summary
from stipple.sources import versions as vs
from stipple.sources.tables import scratch_folder


def edge(step: int = 0):
    """The left edge of a bin, or with 1 the right one."""
    return (F.col("bin") + step) / 64


LAYOUTS = [
    vs.Layout("curve-v4", "/curves_v4/", "cell bigint, bin int, density double, left_um double, right_um double",
              {"cell": "cell", "bin": "bin", "mass": "density * (right_um - left_um)", "left_um": "left_um", "right_um": "right_um"},
              ["cell", "bin", "density"]),
    vs.Layout("curve-v3", "/curves_v3/", "cell bigint, idx int, mass double, left_nm double, right_nm double",
              {"cell": "cell", "bin": "idx", "mass": "mass", "left_um": "left_nm / 1000", "right_um": "right_nm / 1000"},
              ["cell", "idx", "mass"]),
    vs.Layout("curve-v2", "/curves/", "cell bigint, number int, mass double, step_um double",
              {"cell": "cell", "bin": "number - 1", "mass": "mass", "left_um": "(number - 1) * step_um", "right_um": "number * step_um"},
              ["cell", "number", "mass"]),
]


def saved_curves(t) -> str:
    """Curves as four programs left them: three known layouts and one unknown, with planted faults."""
    folder = scratch_folder(t.spark)
    c = t.curves.select("cell", "bin", (F.col("value") / 64).alias("mass"))
    version = F.concat(F.lit("curve-v"), (4 - F.col("cell") % 4).cast("string"))
    declared = F.when(F.col("cell") % 40 == 4, "curve-v3").otherwise(version)
    c = c.withColumn("schema_version", declared)
    own = lambda k: c.where(F.col("cell") % 4 == k)
    right = F.when((F.col("cell") % 44 == 8) & (F.col("bin") == 7), edge()).otherwise(edge(1))
    tables = {
        "curves_v4": own(0).where("not (cell % 36 = 12 and bin = 63)").select(
            "cell", "bin", (F.col("mass") * 64).alias("density"), edge().alias("left_um"), right.alias("right_um"), "schema_version"),
        "curves_v3": own(1).select(
            "cell", F.col("bin").alias("idx"), F.when(~((F.col("cell") % 28 == 5) & (F.col("bin") == 3)), F.col("mass")).alias("mass"),
            (edge() * 1000).alias("left_nm"), (edge(1) * 1000).alias("right_nm"), "schema_version"),
        "curves": own(2).select("cell", (F.col("bin") + 1).alias("number"), "mass", F.lit(1 / 64).alias("step_um"), "schema_version"),
        "curves_old": own(3).select("cell", "bin", "mass", "schema_version"),
    }
    for name, table in tables.items():
        table.write.mode("errorifexists").json(f"{folder}/{name}")
    return folder


SAVED = f"""WITH {CURVES}, s AS (SELECT cell, bin, value / 64 AS mass, CASE WHEN cell % 40 = 4 THEN 'curve-v3' ELSE 'curve-v' || CAST(4 - cell % 4 AS VARCHAR) END AS schema_version,
  CASE WHEN cell % 4 = 3 THEN 'unsupported_schema' WHEN cell % 40 = 4 THEN 'version_and_file_disagree' WHEN cell % 28 = 5 AND bin = 3 THEN 'missing_fields' END AS reason
  FROM curves WHERE NOT (cell % 36 = 12 AND bin = 63))"""


@query("saved_layouts", "SRC-9 SRC-12",
       f"""{SAVED} SELECT cell, schema_version, count(*) AS bins, {R('sum(CASE WHEN cell % 44 = 8 AND bin = 7 THEN 0 ELSE mass END)')} AS mass,
         CASE WHEN count(*) <> 64 THEN 'bin_count' WHEN cell % 44 = 8 THEN 'edges_not_increasing;edges_not_adjacent' ELSE '' END
         || CASE WHEN count(*) <> 64 AND cell % 44 = 8 THEN ';edges_not_increasing;edges_not_adjacent' WHEN cell % 28 = 5 THEN ';edges_not_adjacent' ELSE '' END AS message
         FROM s WHERE reason IS NULL GROUP BY cell, schema_version""")
def saved_layouts(t):
    """Every readable curve whatever its layout, with the verdict on its grid."""
    rows, _ = vs.read_layouts(t.spark, saved_curves(t), LAYOUTS)
    keys = ["cell", "schema_version"]
    mass = rows.groupBy(*keys).agg(F.sum("mass").alias("mass"))
    return round_all(vs.grid_failures(rows, keys, n_bins=64, values=["mass"]).join(mass, keys), "mass")


@query("saved_layout_failures", "SRC-9 SRC-12",
       f"{SAVED} SELECT schema_version, reason, count(*) AS rows_n FROM s WHERE reason IS NOT NULL GROUP BY ALL")
def saved_layout_failures(t):
    _, failures = vs.read_layouts(t.spark, saved_curves(t), LAYOUTS)
    return failures.groupBy("schema_version", "reason").agg(F.sum("rows_n").alias("rows_n"))


SUMMARY = ("positive_mass", "near_mass", "mean_um")
SUMMARIES = [
    vs.Layout("summary-v2", "/curve_summary/", "cell bigint, positive_mass double, near_mass double, mean_um double",
              {c: c for c in ("cell", *SUMMARY)}, ["cell", "positive_mass"]),
    vs.Layout("summary-v1", "/old_summary/", "cell bigint, mass double, near double, mean_nm double",
              {"cell": "cell", "positive_mass": "mass", "near_mass": "near", "mean_um": "mean_nm / 1000"}, ["cell", "mass"]),
]


@query("summary_fallback", "SRC-9",
       f"""WITH {CURVES}, grid_curves AS (SELECT cell, bin, value, bin / 64.0 AS left_um, (bin + 1) / 64.0 AS right_um, (bin + 0.5) / 64.0 AS mid_um FROM curves),
       {positive_sql('grid_curves', 'cell', 'value')},
       a AS (SELECT cell, positive_mass, near_mass, mean_um, cell % 5 AS k FROM positive)
       SELECT cell, CASE WHEN k < 2 THEN 'summary-v2' WHEN k < 4 THEN 'summary-v1' ELSE 'recomputed' END AS origin,
         {R('CASE WHEN k < 2 THEN 1000 + cell WHEN k < 4 THEN 2000 + cell ELSE positive_mass END', 6)} AS positive_mass,
         {R('CASE WHEN k < 2 THEN 0.5 WHEN k < 4 THEN 0.25 ELSE near_mass END', 6)} AS near_mass,
         {R('CASE WHEN k < 2 THEN 0.125 WHEN k < 4 THEN 0.0625 ELSE mean_um END', 6)} AS mean_um FROM a""")
def summary_fallback(t):
    """Summaries of two ages: the newer file counts, else the older one, else the curve is summed up again.

    The saved figures differ from what the curves give, so a row shows where it came from.
    """
    folder = scratch_folder(t.spark)
    cells = t.curves.select("cell").distinct()
    new = cells.where("cell % 5 < 2").select(
        "cell", (F.col("cell") + 1000.0).alias("positive_mass"), F.lit(0.5).alias("near_mass"), F.lit(0.125).alias("mean_um"),
        F.lit("summary-v2").alias("schema_version"))
    old = cells.where("cell % 5 between 1 and 3").select(
        "cell", (F.col("cell") + 2000.0).alias("mass"), F.lit(0.25).alias("near"), F.lit(62.5).alias("mean_nm"),
        F.lit("summary-v1").alias("schema_version"))
    new.write.json(f"{folder}/curve_summary")
    old.write.json(f"{folder}/old_summary")
    rows, _ = vs.read_layouts(t.spark, folder, SUMMARIES)
    saved = vs.newest_saved(rows, ["cell"], ["summary-v2", "summary-v1"])
    curves = t.curves.select("cell", "bin", "value", edge().alias("left_um"), edge(1).alias("right_um"), ((F.col("bin") + 0.5) / 64).alias("mid_um"))
    again = positive_summary(curves.join(saved.select("cell"), "cell", "left_anti"), ["cell"], "value").select("cell", *SUMMARY)
    out = vs.completed(saved, again, ["cell"])
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in SUMMARY})


BLOCK = 1024
IDENTITY = f"""WITH src AS (SELECT n_nationkey AS br, r_name AS condition,
    CASE WHEN n_nationkey % 7 = 3 THEN min(n_nationkey) OVER (PARTITION BY r_name) ELSE n_nationkey END AS source FROM nation JOIN region ON n_regionkey = r_regionkey),
  content AS (SELECT br, string_agg(c_custkey || '|' || c_name || '|' || c_mktsegment, chr(10) ORDER BY c_custkey) || chr(10) AS txt
    FROM src JOIN customer ON c_nationkey = source GROUP BY br),
  ident AS (SELECT br, length(txt) AS length, sha256(array_to_string(list_transform(range(0, CAST(ceil(length(txt) / {BLOCK}.0) AS BIGINT)),
    lambda i: sha256(substring(txt, i * {BLOCK} + 1, {BLOCK}))), '')) AS sha256 FROM content)"""


def replicate_files(t):
    """One input file per nation, some holding another's lines, and the nations with condition and path."""
    folder = scratch_folder(t.spark)
    n = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    smallest = F.min("n_nationkey").over(Window.partitionBy("r_name"))  # a region has a few nations
    n = n.select(F.col("n_nationkey").alias("br"), F.col("r_name").alias("condition"),
                 F.when(F.col("n_nationkey") % 7 == 3, smallest).otherwise(F.col("n_nationkey")).alias("source"))
    line = F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("value")
    lines = n.select("br", "source").join(t.raw("customer"), F.col("c_nationkey") == F.col("source")).select("br", "c_custkey", line)
    (lines.repartition("br").sortWithinPartitions("br", "c_custkey").select("br", "value")
     .write.mode("errorifexists").partitionBy("br").text(folder))
    found = vs.content_identity(t.spark, folder, block_bytes=BLOCK, pattern="*.txt")
    return n.select("br", "condition"), found.withColumn("br", F.regexp_extract("path", "/br=(\\d+)/", 1).cast("int")).drop("path")


@query("input_identity", "AGG-55", f"{IDENTITY} SELECT br, length, sha256 FROM ident")
def input_identity(t):
    return replicate_files(t)[1]


@query("replica_conflicts", "PRJ-30 AGG-55",
       f"""{IDENTITY}, d AS (SELECT br, condition, length, sha256, CASE WHEN br % 12 = 8 THEN 'none' WHEN br % 5 = 2 THEN sha256('other') ELSE upper(sha256) END AS rec,
         CASE WHEN br % 9 = 4 THEN 2 WHEN br % 16 <> 15 THEN 1 END AS tau, CASE WHEN br % 8 = 6 THEN 1 WHEN br % 9 = 4 THEN 2 WHEN br % 16 <> 15 THEN 1 END AS ptau,
         CASE WHEN br % 10 = 9 THEN 0.0 ELSE 0.02 END AS dt, CASE WHEN br % 6 = 1 THEN 0.16 ELSE 0.117 END AS px, CASE WHEN br % 13 = 7 THEN 'bad' WHEN br % 11 = 10 THEN 'long' ELSE 'good' END AS e
         FROM src JOIN ident USING (br)),
       w AS (SELECT *, first_value(coalesce(tau, -1)) OVER g AS tau0, first_value(dt) OVER g AS dt0, first_value(px) OVER g AS px0, first_value(e) OVER g AS e0,
         count(*) OVER (PARTITION BY condition, sha256) AS same FROM d WINDOW g AS (PARTITION BY condition ORDER BY br))
       SELECT * FROM (SELECT condition, br, concat_ws(';', CASE WHEN br % 11 = 5 THEN 'unsupported_schema' END, CASE WHEN tau IS NULL THEN 'incomplete_config' END,
         CASE WHEN coalesce(tau, -1) <> tau0 THEN 'incompatible_config' END, CASE WHEN tau IS DISTINCT FROM ptau THEN 'parameter_mismatch' END,
         CASE WHEN dt <= 0 THEN 'invalid_calibration' END, CASE WHEN dt <> dt0 OR px <> px0 THEN 'incompatible_calibration' END,
         CASE WHEN rec = 'none' THEN 'invalid_sha256' END, CASE WHEN lower(rec) <> sha256 THEN 'sha256_mismatch' END, CASE WHEN br % 9 = 8 THEN 'size_mismatch' END,
         CASE WHEN same > 1 THEN 'duplicate_input' END, CASE WHEN e = 'bad' THEN 'invalid_edges' END, CASE WHEN e <> e0 THEN 'incompatible_edges' END) AS message FROM w)
       WHERE message <> ''""")
def replica_conflicts(t):
    """Declared metadata of the replicates beside their files, with planted faults."""
    nations, found = replicate_files(t)
    b = F.col("br")
    tau = F.when(b % 9 == 4, 2).when(b % 16 != 15, 1)
    edges = [[0.0, 0.1, 0.2], [0.0, 0.1, 0.1], [0.0, 0.1, 0.2, 0.3]]
    good, bad, long = [F.array(*[F.lit(x) for x in e]) for e in edges]
    rows = nations.join(found, "br").withColumns({
        "schema_version": F.when(b % 11 == 5, "replica-v3").otherwise("replica-v4"),
        "tau_frames": tau, "parameter_tau_frames": F.when(b % 8 == 6, 1).otherwise(tau),
        "frame_interval_s": F.when(b % 10 == 9, 0.0).otherwise(0.02), "pixel_um": F.when(b % 6 == 1, 0.16).otherwise(0.117),
        "recorded_sha256": F.when(b % 12 == 8, "none").when(b % 5 == 2, F.sha2(F.lit("other"), 256)).otherwise(F.upper("sha256")),
        "recorded_length": F.when(b % 9 == 8, F.col("length") + 1).otherwise(F.col("length")),
        "edges": F.when(b % 13 == 7, bad).when(b % 11 == 10, long).otherwise(good)})
    return vs.replica_violations(rows, ["condition"], replica="br", schema="replica-v4", config=["tau_frames"],
                                 calibration=["frame_interval_s", "pixel_um"], positive=["frame_interval_s", "pixel_um"])
