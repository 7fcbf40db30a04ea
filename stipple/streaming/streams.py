"""Live movies as Structured Streaming jobs with the same results as the batch operators."""

from __future__ import annotations

from collections.abc import Callable
from time import sleep

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from stipple.functions.columns import bin_index
from stipple.operators import lag_counts
from stipple.session import cut_lineage

cloudpickle.register_pickle_by_value(lag_counts)  # tasks run it where this package is not installed

FRAME_VALUES = 1_000_000  # values of a frame that meet the next frame in one task


def read_events(spark: SparkSession, folder: str, schema, *, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Parquet folder as a stream with a declared schema."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def distinct_events(events: DataFrame, *, key: str = "event_id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drop repeated ids that arrive within the watermark; state stays bounded by the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def support_windows(events: DataFrame, *, time: str, delay: str, window: str, frame: Column, expected: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling windows with their number of distinct frames and validity, emitted once closed.

    Late frames after the watermark are not counted, so their window reports itself incomplete.
    ``expected`` frames are tracked as a set of frame numbers, which the window length bounds.
    """
    w = events.withWatermark(time, delay).groupBy(*by, F.window(time, window).alias("w"))
    out = w.agg(F.count("*").alias("rows_n"), F.size(F.collect_set(frame)).alias("seen"))
    return out.select(
        *by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "rows_n", "seen",
        (F.col("seen") == expected).alias("valid"),
        F.when(F.col("seen") == expected, "").otherwise("incomplete_support_block").alias("reason"))


def support_pixels(foreground: DataFrame, *, time: str, delay: str, window: str, frame: Column) -> DataFrame:
    """Frames per window in which a pixel is foreground, emitted once the window is closed."""
    w = foreground.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), "y", "x")
    return w.agg(F.size(F.collect_set(frame)).alias("support")).select(F.col("w.start").alias("window_start"), "y", "x", "support")


def lag_pairs(points: DataFrame, *, time: str, delay: str, frame_length: str) -> DataFrame:
    """Stream-stream join of frame f with f+1. The time bound lets old state expire on both sides.

    ``points`` has (sample_id, frame, value, time).
    """
    a = points.withWatermark(time, delay).select("sample_id", "frame", "value", F.col(time).alias("ta"))
    b = points.withWatermark(time, delay).select(
        F.col("sample_id").alias("sample2"), (F.col("frame") - 1).alias("frame1"), F.col("value").alias("value2"), F.col(time).alias("tb"))
    near = F.expr(f"tb >= ta and tb <= ta + interval {frame_length} + interval {frame_length}")
    return a.join(b, (F.col("sample_id") == F.col("sample2")) & (F.col("frame") == F.col("frame1")) & near)


def pair_histogram_sink(folder: str, *, n_bins: int, upper: float) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: pairs of a micro-batch become partial histogram counts.

    Each batch owns one folder, so a replayed batch overwrites itself and counts stay exact.
    """

    def sink(pairs: DataFrame, batch: int) -> None:
        d = F.abs(F.col("value") - F.col("value2"))
        kept = pairs.where(d <= upper)
        counts = kept.groupBy("sample_id", "frame", bin_index(d, n_bins, upper).alias("bin")).agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return sink


def lag_histogram_sink(folder: str, *, n_bins: int, upper: float) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: histogram of the distances |value - value2| of all pairs of frame f with f+1 of a sample, without a row for any pair.

    The rows are points (sample_id, frame, value). A batch adds the pairs of which a side is new, so sums over batches don't depend on how the points
    are dealt into batches, and a late point counts as any other. Values of earlier batches are kept counted beside ``folder``; of these a batch
    reads the frames next to its own. Each batch owns one folder in both places, so a replayed batch overwrites itself.
    """

    def sink(points: DataFrame, batch: int) -> None:
        spark, kept = points.sparkSession, f"{folder}-values"
        here = points.where(F.col("sample_id").isNotNull() & F.col("frame").isNotNull() & (F.abs("value") < F.lit(float("inf"))))  # other values have no distance
        here = here.groupBy("sample_id", "frame", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("n"))
        here.write.mode("overwrite").parquet(f"{kept}/batch={batch}")
        new = spark.read.schema(here.schema).parquet(f"{kept}/batch={batch}").withColumn("fresh", F.lit(True))
        first, last = new.agg(F.min("frame"), F.max("frame")).first()
        if first is not None:
            old = spark.read.parquet(kept).where((F.col("batch") < batch) & F.col("frame").between(first - 1, last + 1))
            new = new.unionByName(old.select(*here.columns, F.lit(False).alias("fresh")))
        lag_histogram(new, n_bins=n_bins, upper=upper).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return sink


def lag_histogram(values: DataFrame, *, n_bins: int, upper: float) -> DataFrame:
    """Pairs of frame f with f+1 by sample, frame and bin of their distance, as ``bin_index`` deals them: (sample_id, frame, bin, n).

    ``values`` has (sample_id, frame, value, n, fresh), finite values with their number; a pair counts if one of its sides is fresh. The values of two frames meet in
    one task, which finds the bounds of every bin in the sorted values. A frame of more than ``FRAME_VALUES`` values is dealt into parts, and every two parts meet.
    """
    keys = ["sample_id", "frame", "__a", "__b"]
    parts = values.groupBy("sample_id", "frame").agg((1 + F.floor(F.count("*") / FRAME_VALUES)).alias("__own"))
    hot = (parts.agg(F.max("__own")).first()[0] or 1) > 1
    parts = cut_lineage(parts) if hot else parts

    def side(own: str, other: str, step: int) -> DataFrame:
        """Points with their part and a copy for every part of the other frame."""
        if not hot:
            return values.withColumns({"__a": F.lit(0).cast("long"), "__b": F.lit(0).cast("long")})
        beyond = parts.select("sample_id", (F.col("frame") - step).alias("frame"), F.col("__own").alias("__other"))
        dealt = values.join(parts, ["sample_id", "frame"]).join(beyond, ["sample_id", "frame"])
        dealt = dealt.withColumn(own, F.pmod(F.xxhash64("value"), "__own")).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__other") - 1)))
        return dealt.drop("__own", "__other")

    a = side("__a", "__b", 1).select(*keys, "value", "n", "fresh")
    b = side("__b", "__a", -1).withColumn("frame", F.col("frame") - 1).select(*[F.col(c).alias(f"{c}2") for c in a.columns])  # own names: both sides hold ``values``
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in a.select("sample_id", "frame").schema)

    def count(key, left, right):
        x, y = [left.column(c).to_numpy() for c in ("value", "n", "fresh")], [right.column(c).to_numpy() for c in ("value2", "n2", "fresh2")]
        n = np.zeros(n_bins, dtype=np.int64)
        for new, others in ((x[2], np.ones(len(y[2]), dtype=bool)), (~x[2].astype(bool), y[2])):
            new, others = new.astype(bool), others.astype(bool)
            if new.any() and others.any():
                n += lag_counts.distances_in_bins(x[0][new], x[1][new], y[0][others], y[1][others], n_bins, upper)
        found = np.flatnonzero(n)
        return pa.table([*[pa.array([k.as_py()] * len(found), k.type) for k in key[:2]], pa.array(found.astype(np.int32)), pa.array(n[found])],
                        names=["sample_id", "frame", "bin", "n"])

    each = a.groupBy(*keys).cogroup(b.groupBy(*[f"{k}2" for k in keys])).applyInArrow(count, fields + ", bin int, n long")
    return each.groupBy("sample_id", "frame", "bin").agg(F.sum("n").alias("n"))


def class_counts(points: DataFrame, *, time: str = "ts", delay: str = "1 hour", frame_length: str = "1 hour") -> DataFrame:
    """Running counts per sample, frame and class, conserved over the rows that come within the watermark. For update mode.

    A frame belongs to one time window, so its state is dropped once the watermark has passed the window.
    """
    w = points.withWatermark(time, delay).groupBy("sample_id", "frame", F.window(time, frame_length).alias("w"))
    return w.agg(
        F.count_if(F.col("grp") == "On").alias("on"), F.count_if(F.col("grp") == "Not-on").alias("not_on"),
        F.count_if(F.col("grp") == "unknown").alias("unknown"), F.count("*").alias("total")).drop("w")


def with_roster(closed: DataFrame, roster: DataFrame, keys: list[str], *, reason: str = "window_not_closed") -> DataFrame:
    """Every window of the roster; one that the stream hasn't closed, or that had no row, is unknown and not empty."""
    out = roster.join(closed, keys, "left")
    return out.withColumns({"valid": F.coalesce("valid", F.lit(False)), "reason": F.coalesce("reason", F.lit(reason))})


def versioned_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink for update mode: every batch keeps its rows under its own number."""

    def sink(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return sink


def latest_version(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Newest row per key of a versioned folder."""
    rows = spark.read.parquet(folder)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def node_refresh_sink(partials: str, nodes: str, *, sample: str, node: str, value: str) -> Callable[[DataFrame, int], None]:
    """Recompute only the nodes whose samples occur in the batch.

    Per-sample sums of each batch are stored; the touched nodes are then summed again from the
    stored partials, equal weight per sample, and written as that batch's version.
    """

    def sink(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        sums = rows.groupBy(node, sample).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
        sums.write.mode("overwrite").parquet(f"{partials}/batch={batch}")
        mine = spark.read.parquet(f"{partials}/batch={batch}").select(node).distinct()
        stored = spark.read.parquet(partials).where(F.col("batch") <= batch).join(mine, node, "left_semi")
        cells = stored.groupBy(node, sample).agg((F.sum("s") / F.sum("n")).alias("mean"))
        fresh = cells.groupBy(node).agg(F.avg("mean").alias("mean"), F.count("*").alias("samples"))
        fresh.write.mode("overwrite").parquet(f"{nodes}/batch={batch}")

    return sink


def counted_distinct_events(events: DataFrame, *, key: str = "event_id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """``distinct_events`` with two observed metrics, rows that arrive and rows that are kept, for ``DuplicateCounter``."""
    arrived = events.observe("arrived", F.count(F.lit(1)).alias("n"))
    return distinct_events(arrived, key=key, time=time, delay=delay).observe("kept", F.count(F.lit(1)).alias("n"))


class DuplicateCounter(StreamingQueryListener):
    """Listener: per batch the rows that arrived, were kept, came behind the watermark, and the duplicates that remain."""

    def __init__(self, name: str):
        self.name, self.batches = name, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name or "arrived" not in p.observedMetrics:
            return
        late = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        arrived, kept = p.observedMetrics["arrived"]["n"], p.observedMetrics["kept"]["n"]
        if arrived or p.batchId not in self.batches:  # a batch without data may follow under the same number
            self.batches[p.batchId] = (arrived, kept, late, arrived - kept - late)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_counted(stream: DataFrame, folder: str, name: str) -> list[tuple[int, int, int, int, int]]:
    """Process everything available; (batch, arrived, kept, late, duplicates) for each batch with rows."""
    spark, counter = stream.sparkSession, DuplicateCounter(name)
    spark.streams.addListener(counter)
    try:
        writer = stream.writeStream.queryName(name).outputMode("append").option("checkpointLocation", f"{folder}-checkpoint")
        query = writer.trigger(availableNow=True).format("parquet").option("path", folder).start()
        query.awaitTermination()
        wanted = {p.batchId for p in query.recentProgress if p.numInputRows}
        for _ in range(100):  # events arrive after the query has ended
            if wanted <= set(counter.batches):
                break
            sleep(0.1)
    finally:
        spark.streams.removeListener(counter)
    return [(b, *n) for b, n in sorted(counter.batches.items()) if n[0]]


def keyed_refresh_sink(state: str, nodes: str, *, sample: str, node: str, value: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Equal-weight node means from running sums per (node, sample), kept by bucket of the node.

    A batch reads and rewrites only the buckets of its own nodes. A bucket holds one row for each (node, sample) whatever the number of
    batches, so what a batch reads does not grow with the stream. Each bucket names the last batch that it holds; a replayed
    batch leaves such buckets as they are. ``nodes`` has the current mean of every node.
    """

    def sink(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        bucket = F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int").alias("bucket")
        sums = cut_lineage(rows.groupBy(bucket, node, sample).agg(F.sum(value).alias("s"), F.count(value).alias("n")))
        touched = [r["bucket"] for r in sums.select("bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        schema = ", ".join(f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in (node, sample)) + ", s double, n long, batch long"
        if batch == 0:
            spark.createDataFrame([], schema + ", bucket int").write.mode("append").partitionBy("bucket").parquet(state)
        stored = cut_lineage(spark.read.schema(schema + ", bucket int").parquet(state).where(F.col("bucket").isin(touched)))
        done = stored.groupBy("bucket").agg(F.max("batch").alias("held")).where(F.col("held") >= batch).select("bucket")
        new = sums.join(done, "bucket", "left_anti").select("bucket", node, sample, F.col("s").cast("double"), "n")
        merged = stored.select("bucket", node, sample, "s", "n").unionByName(new).groupBy("bucket", node, sample).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        merged = cut_lineage(merged.withColumn("batch", F.lit(batch).cast("long")))
        cells = merged.where("n > 0").groupBy("bucket", node, sample).agg((F.sum("s") / F.sum("n")).alias("mean"))
        fresh = cells.groupBy("bucket", node).agg(F.avg("mean").alias("mean"), F.count("*").alias("samples"))
        for rows_, folder in ((fresh, nodes), (merged, state)):  # the state last: it says that the batch is done
            rows_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)

    return sink


def run_available(stream: DataFrame, folder: str, *, sink: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> None:
    """Process everything available and stop. The checkpoint beside the output makes restarts exact."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True)
    if sink is not None:
        query = writer.foreachBatch(sink).start()
    else:
        query = writer.format("parquet").option("path", folder).start()
    query.awaitTermination()
