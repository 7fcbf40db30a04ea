"""Readers, writers and streaming jobs in several micro-batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stipple.sources import readers as rd
from stipple.sources import tables as tb
from stipple.streaming import streams as st

SCHEMA = "event_id bigint, sample_id int, ts timestamp, frame int, value double, grp string"
START = dt.datetime(2024, 1, 1)


def test_missing_column_is_refused(spark, tmp_path):
    spark.createDataFrame([("u", 1)], "uid string, frame int").write.option("header", True).csv(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="missing required columns"):
        rd.read_localizations(spark, str(tmp_path / "t"))


def test_csv_round_trip_keeps_full_precision_and_blanks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1 + 0.2, None, {"k": 1}), ("b", 1e-17, 2.0, {})], "id string, v double, w double, m map<string,int>")
    tb.write_csv(df, str(tmp_path / "c"))
    back = {r["id"]: r for r in spark.read.schema("id string, v double, w double, m string").option("header", True).option("quote", '"').option("escape", "\\").csv(str(tmp_path / "c")).collect()}
    assert back["a"]["v"] == 0.1 + 0.2 and back["a"]["w"] is None and back["a"]["m"] == '{"k":1}' and back["b"]["v"] == 1e-17


def test_manifest_defaults_duplicates_and_bom(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("﻿condition_id,target_id,replicate_id,cell_id,input_file,enabled\nWT,T,1,a,x.mat,\nWT,T,1,a,/y.mat,no\nWT,T,1,b,z.mat,Y\n".encode())
    rows, dup = rd.read_manifest(spark, str(tmp_path / "m.csv"))
    r = rd.resolve_paths(rows, "/d").orderBy("input_file").collect()
    assert [x["input_file"] for x in r] == ["/d/x.mat", "/d/z.mat", "/y.mat"] and [x["enabled"] for x in r] == [True, True, False]
    assert r[0]["coordinate_unit"] == "m" and [x["n"] for x in dup.collect()] == [2]


def test_folder_inventory_and_fingerprints(spark, tmp_path):
    for p in ("WT/010224_BR1/T1/C1.tif", "WT/010224_BR1/T1/C2.tif", "WT/010224_BR1/T2/C1.tif"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    files = rd.path_parts(rd.list_files(spark, str(tmp_path)), r"/([^/]+)/([^/]+)/([^/]+)/(C\d)\.tif$", ["condition", "folder", "cell", "channel"])
    inv = {r["cell"]: r for r in rd.sample_inventory(files, ["condition", "folder", "cell"], {c: F.col("channel") == c for c in ("C1", "C2")}, date_text="folder").collect()}
    assert inv["T1"]["complete"] and not inv["T2"]["complete"] and inv["T1"]["acquired"] == dt.date(2024, 1, 2)
    assert rd.file_fingerprints(spark, str(tmp_path)).select("sha256").distinct().count() == 3


def test_base_records_drop_filtered_copies(spark):
    df = spark.createDataFrame([("f", "a"), ("f", "a_SpotsMaskFiltered"), ("f", "b_TracksFiltered"), ("f", "a")], "file string, name string")
    base, dup = rd.base_records(df, file="file", name="name")
    assert base.count() == 2 and [r["n"] for r in dup.collect()] == [2]


def test_time_must_lie_on_the_frame_grid(spark):
    df = spark.createDataFrame([(0.06,), (0.06 + 1e-12,), (0.07,)], "t double")
    assert [r["frame"] for r in rd.time_to_frame(df, time="t", interval=0.02).collect()] == [3, 3, None]


def write_batches(spark, folder, batches):
    """One file per batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def event(i, hours, value=1.0, sample=1, grp="On"):
    return (i, sample, START + dt.timedelta(hours=hours), int(hours), value, grp)


def stream(spark, folder):
    return st.read_events(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)


def test_late_frame_leaves_its_window_unknown(spark, tmp_path):
    write_batches(spark, tmp_path / "in", [[event(0, 0), event(1, 1)], [event(2, 2), event(4, 9)], [event(5, 10)], [event(3, 3), event(6, 20)], [event(7, 30)]])
    out = str(tmp_path / "out")
    st.run_available(st.support_windows(stream(spark, tmp_path / "in"), time="ts", delay="1 hour", window="2 hours", frame=F.col("frame"), expected=2), out)
    got = {r["window_start"].hour: r["valid"] for r in spark.read.parquet(out).collect()}
    assert got[0] is True and got[2] is False and got[10] is False


def test_stream_pairs_equal_batch_pairs(spark, tmp_path):
    rows = [event(i, h, value=float(i % 5), sample=i % 2) for i, h in enumerate([0, 0, 1, 1, 2, 2, 3, 4, 4, 5])]
    write_batches(spark, tmp_path / "in", [rows[:4], rows[4:7], rows[7:]])
    out = str(tmp_path / "out")
    st.run_available(st.lag_pairs(stream(spark, tmp_path / "in"), time="ts", delay="2 hours", frame_length="1 hour"), out,
                     sink=st.pair_histogram_sink(out, n_bins=5, upper=5.0))
    got = spark.read.parquet(out).agg(F.sum("n")).first()[0]
    assert got == sum(a[1] == b[1] and a[3] + 1 == b[3] for a in rows for b in rows)


def test_repeats_are_dropped_across_batches(spark, tmp_path):
    write_batches(spark, tmp_path / "in", [[event(1, 0), event(2, 0)], [event(1, 0), event(3, 0)]])
    out = str(tmp_path / "out")
    st.run_available(st.distinct_events(stream(spark, tmp_path / "in")).select("event_id"), out)
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_running_counts_keep_the_newest_version(spark, tmp_path):
    write_batches(spark, tmp_path / "in", [[event(1, 0), event(2, 0, grp="unknown")], [event(3, 0, grp="Not-on"), event(4, 1)]])
    out = str(tmp_path / "out")
    st.run_available(st.class_counts(stream(spark, tmp_path / "in")), out, sink=st.versioned_sink(out), mode="update")
    got = {r["frame"]: (r["on"], r["not_on"], r["unknown"], r["total"]) for r in st.latest_version(spark, out, ["sample_id", "frame"]).collect()}
    assert got == {0: (1, 1, 1, 3), 1: (1, 0, 0, 1)}


def test_only_touched_nodes_are_refreshed(spark, tmp_path):
    write_batches(spark, tmp_path / "in", [[event(1, 0, 1.0, 1, "A"), event(2, 0, 5.0, 2, "B")], [event(3, 1, 3.0, 3, "A")]])
    out = str(tmp_path / "out")
    st.run_available(stream(spark, tmp_path / "in"), out, sink=st.node_refresh_sink(out + "-p", out, sample="sample_id", node="grp", value="value"))
    versions = {(r["grp"], r["batch"]) for r in spark.read.parquet(out).collect()}
    assert len([v for v in versions if v[0] == "B"]) == 1 and len([v for v in versions if v[0] == "A"]) == 2
    assert {r["grp"]: (r["mean"], r["samples"]) for r in st.latest_version(spark, out, ["grp"]).collect()} == {"A": (2.0, 2), "B": (5.0, 1)}


def test_refresh_reads_the_nodes_of_its_batch_only(spark, tmp_path):
    """Rows held by a bucket do not grow with batches; a replayed batch changes nothing; untouched buckets keep their files."""
    rng = random.Random(3)
    state, nodes = f"{tmp_path}/state", f"{tmp_path}/nodes"
    sink = st.keyed_refresh_sink(state, nodes, sample="sample", node="node", value="value", buckets=8)
    seen, sizes = [], []
    for batch in range(5):
        rows = [(n, n * 10 + rng.randrange(3), rng.random()) for n in ([0, 1, 2, 3, 4, 5] if batch < 2 else [1, 2]) for _ in range(20)]
        seen += rows
        frame = spark.createDataFrame(rows, "node int, sample int, value double")
        for _ in range(2 if batch in (1, 3) else 1):
            sink(frame, batch)
        sizes.append(spark.read.parquet(state).count())
    assert sizes == [18] * 5
    means = {}
    for n, s, v in seen:
        means.setdefault(n, {}).setdefault(s, []).append(v)
    got = {r["node"]: (r["mean"], r["samples"]) for r in spark.read.parquet(nodes).collect()}
    assert got == {n: (pytest.approx(sum(sum(v) / len(v) for v in m.values()) / len(m)), len(m)) for n, m in means.items()}
    held = {r["node"]: r["batch"] for r in spark.read.parquet(state).collect()}
    assert held[1] == held[2] == 4
    touched = {r["bucket"] for r in spark.read.parquet(state).where("node in (1, 2)").select("bucket").collect()}
    assert all(r["batch"] == 1 for r in spark.read.parquet(state).collect() if r["bucket"] not in touched)


def test_two_digit_years_turn_at_69(spark):
    import datetime as dt

    texts = ["010268", "010269", "022996", "123199", "022900", "133099", "022997"]
    rows = rd.sample_inventory(spark.createDataFrame([(t, t) for t in texts], "folder string, stamp string"), ["folder"], {}, date_text="stamp").collect()
    got = {r["folder"]: r["acquired"] for r in rows}
    assert [got[t] for t in texts] == [dt.date(2068, 1, 2), dt.date(1969, 1, 2), dt.date(1996, 2, 29), dt.date(1999, 12, 31), dt.date(2000, 2, 29), None, None]


def test_batches_of_several_files_stay_whole(spark, monkeypatch, tmp_path):
    from stipple.catalog import streams as cs
    from stipple.sources.standins import Tables

    monkeypatch.setattr(cs, "FILE_ROWS", 20)
    rows = cs.stream_duplicate_counts(Tables(spark, "/root/testdata/sf0.001")).collect()
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert [r["batch"] for r in rows] == [0, 1, 2, 3] and sum(r["kept"] for r in rows) == n
    monkeypatch.setattr(cs, "scratch_folder", lambda _: str(tmp_path))
    cs.in_files(Tables(spark, "/root/testdata/sf0.001"), False)
    assert [len(list((tmp_path / f"f{k}").glob("*.parquet"))) for k in range(cs.FILES)] == [1 + n // 20] * cs.FILES


def test_saved_points_are_few_files_in_order(spark, tmp_path):
    """A folder for each sample would be 500 files."""
    rows = [(f"{s}-{f}", s, f, float(s), float(f)) for s in range(500) for f in range(3)]
    df = spark.createDataFrame(rows, "uid string, sample_id long, frame int, x_px double, y_px double")
    rd.to_parquet(df, str(tmp_path / "p"))
    files = list((tmp_path / "p").rglob("*.parquet"))
    assert len(files) <= 8
    for f in files:
        kept = [(r["sample_id"], r["frame"]) for r in spark.read.parquet(str(f)).select("sample_id", "frame").collect()]
        assert kept == sorted(kept)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(rows) and back.schema["sample_id"].dataType.simpleString() == "bigint"


@pytest.mark.parametrize("name", ["stream_class_counts", "stream_lag_pair_histogram", "stream_support_windows"])
def test_events_may_be_a_folder_of_files(spark, tmp_path, name):
    """The same rows as one file and as several give the same result; a row of an early hour may stand in any of them."""
    import duckdb

    from stipple.catalog import load
    from stipple.catalog.registry import runnable

    rnd = random.Random(3)
    rows = [(k, START + dt.timedelta(minutes=rnd.randrange(60 * 50)), rnd.randrange(40), "view", float(rnd.randrange(400)), "{}") for k in range(900)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(4).write.parquet(str(tmp_path / "many" / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/many/events.parquet/*.parquet'")
    (tmp_path / "one").mkdir()
    con.execute(f"COPY events TO '{tmp_path}/one/events.parquet' (FORMAT parquet)")
    entry = load()[name]
    want = con.execute(entry.sql)
    columns = [d[0] for d in want.description]
    want = sorted(map(str, want.fetchall()))
    for form in ("one", "many"):
        got = runnable(entry)(spark, str(tmp_path / form)).select(*columns).collect()
        assert sorted(str(tuple(r)) for r in got) == want, form
