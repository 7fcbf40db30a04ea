"""The general-purpose Parquet tables seen through the point / pixel / curve schemas."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PX_NM = 117.0  # Fixed value: pixel pitch in nanometres.
FRAME_S = 0.02  # Fixed value: frame interval in seconds.
GRID = 12  # the stand-in image is GRID x GRID pixels
BLOCK_FRAMES = 24
N_BINS = 30
MAX_UM = 3.0
WIDTH_UM = MAX_UM / N_BINS
ROI_VERTICES = [(1.5, 1.5), (9.5, 1.5), (9.5, 6.5), (5.5, 9.5), (1.5, 9.5)]


class Tables:
    """Lazy views over one data folder. Each property is a fresh logical plan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def points(self) -> DataFrame:
        days = F.datediff("l_shipdate", F.lit("1995-01-01"))
        day_text = F.date_format("l_shipdate", "yyyy-MM-dd")
        return self.raw("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day_text).alias("uid"),
            F.col("l_suppkey").alias("sample_id"),
            F.floor(days / 7).cast("int").alias("frame"),
            (F.col("l_quantity") * 0.06).alias("x_um"),
            (F.col("l_extendedprice") / 35000.0).alias("y_um"),
            (F.col("l_quantity") * 0.22).alias("x_px"),
            (F.col("l_extendedprice") / 9600.0).alias("y_px"),
            (F.lit(0.3) + F.col("l_discount") * 5).alias("x_se_px"),
            (F.lit(0.3) + F.col("l_tax") * 5).alias("y_se_px"),
            (F.lit(PX_NM) * (F.lit(0.3) + F.col("l_discount") * 5)).alias("x_se_nm"),
            (F.lit(PX_NM) * (F.lit(0.3) + F.col("l_tax") * 5)).alias("y_se_nm"),
            (F.col("l_discount") <= 0.08).alias("qc"),
            F.when(F.col("l_returnflag") == "A", "On").when(F.col("l_returnflag") == "N", "Not-on")
            .otherwise("unknown").alias("grp"),
            F.col("l_extendedprice").alias("photons_e"),
        )

    @cached_property
    def selected(self) -> DataFrame:
        """Points that pass QC: the rows every grouped analysis starts from."""
        return self.points.where("qc")

    @cached_property
    def movies(self) -> DataFrame:
        """Selected points pooled into twenty dense movies, for grouped pair statistics."""
        return self.selected.withColumn("sample_id", F.col("sample_id") % 20)

    @cached_property
    def inventory(self) -> DataFrame:
        """Expected samples: every replicate (nation) of every condition (region), cells where present."""
        sites = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return sites.join(self.raw("supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
            F.col("s_suppkey").alias("sample_id"), F.col("n_nationkey").alias("br"), F.col("r_name").alias("condition")
        )

    @cached_property
    def pixels(self) -> DataFrame:
        # a difference of wall-clock times, whatever the session's time zone
        hour = F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 3600)
        return (
            self.raw("events")
            .select(
                hour.cast("int").alias("frame"),
                (F.col("event_id") % GRID).cast("int").alias("y"),
                (F.floor(F.col("event_id") / GRID) % GRID).cast("int").alias("x"),
                "value",
            )
            .groupBy("frame", "y", "x")
            .agg(F.max("value").alias("value"))
        )

    @cached_property
    def day_pixels(self) -> DataFrame:
        """The same movie at one frame per day, for per-frame robust statistics."""
        return self.pixels.groupBy(F.floor(F.col("frame") / 24).cast("int").alias("frame"), "y", "x").agg(
            F.max("value").alias("value")
        )

    @cached_property
    def broad(self) -> DataFrame:
        return self.pixels.where("value >= 50").select("frame", "y", "x")

    @cached_property
    def frame_map(self) -> DataFrame:
        """Every frame from the first to the last that the events reach, with its block counted from the first.

        A frame takes part when it has events and isn't declared missing (13 modulo 97).
        """
        seen = self.pixels.select("frame").distinct()
        span = seen.agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
        frames = span.select("lo", F.explode(F.sequence("lo", "hi")).alias("frame"))
        return frames.join(seen.withColumn("seen", F.lit(True)), "frame", "left").select(
            "frame",
            F.floor((F.col("frame") - F.col("lo")) / BLOCK_FRAMES).cast("int").alias("block"),
            (F.coalesce("seen", F.lit(False)) & (F.col("frame") % 97 != 13)).alias("participating"),
        )

    @cached_property
    def grid(self) -> DataFrame:
        """All pixels of the image."""
        return self.spark.range(GRID * GRID).select(
            F.floor(F.col("id") / GRID).cast("int").alias("y"), (F.col("id") % GRID).cast("int").alias("x")
        )

    @cached_property
    def roi(self) -> DataFrame:
        return self.grid.where("x between 2 and 9 and y between 2 and 9")

    @cached_property
    def curves(self) -> DataFrame:
        """Signed per-cell curves, one row per bin."""
        e = self.raw("embeddings")
        return e.select(
            F.col("vec_id").alias("cell"),
            F.col("label").alias("br"),
            (F.col("label") % 3).alias("condition"),
            F.posexplode("embedding").alias("bin", "v"),
        ).select("cell", "br", "condition", "bin", F.col("v").cast("double").alias("value"))

    @cached_property
    def cell_metrics(self) -> DataFrame:
        """One row per cell with saved counts, areas and their availability."""
        low = F.col("o_orderpriority") == "5-LOW"
        status = F.col("o_orderstatus")
        first = F.min_by("o_totalprice", F.struct("o_orderdate", "o_orderkey"))
        sums = self.raw("orders").groupBy("o_custkey").agg(
            F.count_if(low).alias("qc_excluded"),
            F.count_if(~low & (status == "F")).alias("on"),
            F.count_if(~low & (status == "O")).alias("not_on"),
            F.count_if(~low & (status == "P")).alias("unknown"),
            F.avg("o_totalprice").alias("area"),
            first.alias("first_area"),
        )
        sites = self.raw("customer").join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        cells = sites.select(
            F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("br"), F.col("n_regionkey").alias("condition"),
            F.when(F.col("c_acctbal") < 5000, "P1").otherwise("P2").alias("protein"),
        )
        selected = F.col("on") + F.col("not_on") + F.col("unknown")
        known = F.col("on") + F.col("not_on")
        return cells.join(sums, F.col("cell") == F.col("o_custkey"), "left").select(
            "cell", "br", "condition", "protein", "on", "not_on", "unknown", "qc_excluded",
            selected.alias("selected"), (selected + F.col("qc_excluded")).alias("roi_candidates"),
            "area", "first_area", F.when(known > 0, F.col("on") * 100.0 / known).alias("on_pct"),
        )

    @cached_property
    def labelings(self) -> DataFrame:
        """Two labelings of the same items, long form of (uid, method, label)."""
        d = self.raw("documents").select("doc_id").join(self.raw("labels"), "doc_id", "left")

        def name(c):
            return F.when(F.col(c) == 1, "On").when(F.col(c) == 0, "Not-on").otherwise("unknown")

        return d.select(F.col("doc_id").alias("uid"), name("quality").alias("a"), name("toxic").alias("b"))

    @cached_property
    def completions(self) -> DataFrame:
        return self.raw("conversations").select(
            F.col("conv_id").alias("sample_id"), F.col("turn").alias("path"), F.col("role").alias("digest")
        )

    @cached_property
    def folders(self) -> DataFrame:
        """A folder listing stand-in: host / language / number play condition / replicate / cell."""
        return self.raw("pages").select(F.col("page_id"), F.col("url").alias("path"))
