"""Histograms of lag distances without pairs."""

import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyspark
import pytest
from pyspark import cloudpickle

from stipple.streaming import streams as st

SCHEMA = "sample_id long, frame int, value double"


def brute(rows, n_bins, upper):
    """Bins of every pair of a frame with the next one, by true edges."""
    edges, found = [k * (upper / n_bins) for k in range(1, n_bins)], Counter()
    good = [r for r in rows if None not in r and abs(r[2]) < float("inf")]
    for s, f, v in good:
        for s2, f2, v2 in good:
            if s == s2 and f2 == f + 1 and abs(v - v2) <= upper:
                found[s, f, sum(abs(v - v2) >= e for e in edges)] += 1
    return found


def points(n, seed):
    """Values that repeat, lie on edges or a rounding away from them, or have no distance."""
    rnd = random.Random(seed)
    value = lambda: rnd.choice([rnd.randrange(60) / 10, rnd.random() * 6, 0.1 + 0.2, 0.3, 1.1 * 3, None, float("nan"), float("inf"), -0.0, 1e308, -1e308])
    return [(rnd.choice([1, 2, None]), rnd.choice([0, 1, 2, 4, None]), value()) for _ in range(n)]


@pytest.mark.parametrize("part", [1_000_000, 7])
def test_batches_add_the_pairs_that_they_make(spark, tmp_path, monkeypatch, part):
    """Any order of batches, late frames and replays included, gives the pairs of all rows; so do frames dealt into parts."""
    monkeypatch.setattr(st, "FRAME_VALUES", part)
    rows = points(150, 4)
    sink = st.lag_histogram_sink(str(tmp_path / "out"), n_bins=7, upper=2.1)
    for batch, given in enumerate((rows[100:], [], rows[:40], rows[40:100])):
        for _ in range(2 if batch == 2 else 1):
            sink(spark.createDataFrame(given, SCHEMA), batch)
    got = Counter()
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got[r["sample_id"], r["frame"], r["bin"]] += r["n"]
    assert got == brute(rows, 7, 2.1) and len(got) > 10


def test_dense_frames_are_counted_without_pairs(spark):
    """Two frames of 200,000 points have 40 billion pairs."""
    n = 200_000
    rows = spark.range(2 * n).selectExpr("1L AS sample_id", "CAST(id % 2 AS INT) AS frame", "CAST(id DIV 2 AS DOUBLE) AS value", "1L AS n", "true AS fresh")
    got = {r["bin"]: r["n"] for r in st.lag_histogram(rows, n_bins=4, upper=8.0).collect()}
    at = lambda d: n if d == 0 else 2 * (n - d)
    assert got == {0: at(0) + at(1), 1: at(2) + at(3), 2: at(4) + at(5), 3: at(6) + at(7) + at(8)}


def test_the_query_keeps_late_hours(spark, tmp_path, monkeypatch):
    """Hours that come after the watermark of a join would have passed them still pair with their neighbours."""
    import datetime as dt

    import duckdb

    from stipple.catalog import load, streams as cs
    from stipple.sources.standins import Tables

    start, rnd = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), random.Random(8)
    rows = [(k, start + dt.timedelta(minutes=rnd.randrange(60 * 30)), rnd.randrange(24), "view", float(rnd.randrange(400)), "{}") for k in range(600)]
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    for part in (2, 1, 0):  # the latest hours are the first batch
        mine = [r for r in rows if (r[1] - start) // dt.timedelta(hours=10) == part]
        spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    files = cs.live
    monkeypatch.setattr(cs, "live", lambda t: st.read_events(spark, str(tmp_path / "events.parquet"), files(t).schema, files_per_batch=1))
    got = load()["stream_lag_pair_histogram"].build(Tables(spark, str(tmp_path))).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(load()["stream_lag_pair_histogram"].sql).fetchall()
    assert sorted((r["sample_id"], r["bin"], r["n"]) for r in got) == sorted(want)


def test_tasks_need_no_installed_package(spark, tmp_path):
    """What a task runs is sent as a whole: workers may stand in a folder from which the package can't be imported."""
    fn, given = st.lag_counts.distances_in_bins, [np.array(v) for v in ([0.0, 1.0], [1, 2], [1.0], [1])]
    (tmp_path / "fn").write_bytes(cloudpickle.dumps(lambda: fn(*given, 2, 2.0).tolist()))
    code = "import sys; sys.path[:0] = sys.argv[2:]; from pyspark import cloudpickle; print(cloudpickle.loads(open(sys.argv[1], 'rb').read())())"
    done = subprocess.run([sys.executable, "-I", "-c", code, str(tmp_path / "fn"), str(Path(pyspark.__file__).parents[1])], cwd="/", capture_output=True, text=True)
    assert done.stdout.strip() == "[2, 1]", done.stderr
