"""Registry of named queries, their DuckDB twins and the inventory rows they cover."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stipple.sources.standins import Tables


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``build(tables)`` under ``name``; ``covers`` lists inventory ids."""

    def wrap(build):
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, build, sql, tuple(covers.split()))
        return build

    return wrap


def runnable(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return entry.build(Tables(spark, sf_dir))

    return run


def R(expr: str, digits: int = 9) -> str:
    """Rounded SQL value; adding zero removes a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def sql_bin(d: str, n: int, upper: float) -> str:
    """The edge-corrected histogram bin as SQL."""
    w = repr(upper / n)
    g = f"least(CAST(floor({d}/CAST('{w}' AS DOUBLE)) AS INTEGER), {n - 1})"
    w = f"CAST('{w}' AS DOUBLE)"
    return (
        f"CASE WHEN {d} < {g}*{w} THEN {g}-1 WHEN {g} < {n - 1} AND {d} >= ({g}+1)*{w} THEN {g}+1 ELSE {g} END"
    )


# SQL twins of the stand-in views, used as leading CTEs.
POINTS = """
points AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                   CAST(l_suppkey AS VARCHAR), strftime(l_shipdate, '%Y-%m-%d')) AS uid,
         l_suppkey AS sample_id,
         CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 7.0) AS INTEGER) AS frame,
         l_quantity * 0.06 AS x_um, l_extendedprice / 35000.0 AS y_um,
         l_quantity * 0.22 AS x_px, l_extendedprice / 9600.0 AS y_px,
         CAST(0.3 AS DOUBLE) + l_discount * 5 AS x_se_px, CAST(0.3 AS DOUBLE) + l_tax * 5 AS y_se_px,
         CAST(117.0 AS DOUBLE) * (CAST(0.3 AS DOUBLE) + l_discount * 5) AS x_se_nm,
         CAST(117.0 AS DOUBLE) * (CAST(0.3 AS DOUBLE) + l_tax * 5) AS y_se_nm,
         l_discount <= CAST(0.08 AS DOUBLE) AS qc,
         CASE l_returnflag WHEN 'A' THEN 'On' WHEN 'N' THEN 'Not-on' ELSE 'unknown' END AS grp,
         l_extendedprice AS photons_e
  FROM lineitem),
selected AS (SELECT * FROM points WHERE qc),
movies AS (SELECT * REPLACE (sample_id % 20 AS sample_id) FROM selected)
"""
INVENTORY = """
inventory AS (
  SELECT s_suppkey AS sample_id, n_nationkey AS br, r_name AS condition
  FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey)
"""
PIXELS = """
pixels AS (
  SELECT CAST(floor((epoch_ms(ts) // 1000 - 1704067200) / 3600.0) AS INTEGER) AS frame,
         CAST(event_id % 12 AS INTEGER) AS y, CAST((event_id // 12) % 12 AS INTEGER) AS x, max(value) AS value
  FROM events GROUP BY 1, 2, 3),
day_pixels AS (
  SELECT CAST(floor(frame / 24.0) AS INTEGER) AS frame, y, x, max(value) AS value FROM pixels GROUP BY 1, 2, 3),
broad AS (SELECT frame, y, x FROM pixels WHERE value >= 50),
frame_map AS (
  SELECT CAST(r AS INTEGER) AS frame, CAST((r - lo) // 24 AS INTEGER) AS block,
         r % 97 <> 13 AND r IN (SELECT frame FROM pixels) AS participating
  FROM (SELECT lo, unnest(range(lo, hi + 1)) AS r FROM (SELECT min(frame) AS lo, max(frame) AS hi FROM pixels))),
grid AS (SELECT CAST(r // 12 AS INTEGER) AS y, CAST(r % 12 AS INTEGER) AS x FROM range(144) t(r)),
roi AS (SELECT * FROM grid WHERE x BETWEEN 2 AND 9 AND y BETWEEN 2 AND 9)
"""
CURVES = """
curves AS (
  SELECT vec_id AS cell, label AS br, label % 3 AS condition, CAST(i AS INTEGER) AS bin,
         CAST(embedding[i + 1] AS DOUBLE) AS value
  FROM embeddings, (SELECT r AS i FROM range(64) t(r)))
"""
METRICS = """
cell_metrics AS (
  SELECT c_custkey AS cell, c_nationkey AS br, n_regionkey AS condition,
         CASE WHEN c_acctbal < 5000 THEN 'P1' ELSE 'P2' END AS protein,
         "on", not_on, unknown, qc_excluded, "on" + not_on + unknown AS selected,
         "on" + not_on + unknown + qc_excluded AS roi_candidates, area, first_area,
         CASE WHEN "on" + not_on > 0 THEN "on" * 100.0 / CAST("on" + not_on AS DOUBLE) END AS on_pct
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (
    SELECT o_custkey,
           count(*) FILTER (o_orderpriority = '5-LOW') AS qc_excluded,
           count(*) FILTER (o_orderpriority <> '5-LOW' AND o_orderstatus = 'F') AS "on",
           count(*) FILTER (o_orderpriority <> '5-LOW' AND o_orderstatus = 'O') AS not_on,
           count(*) FILTER (o_orderpriority <> '5-LOW' AND o_orderstatus = 'P') AS unknown,
           avg(o_totalprice) AS area,
           arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_area
    FROM orders GROUP BY 1) s ON s.o_custkey = c_custkey)
"""
LABELINGS = """
labelings AS (
  SELECT doc_id AS uid,
         CASE quality WHEN 1 THEN 'On' WHEN 0 THEN 'Not-on' ELSE 'unknown' END AS a,
         CASE toxic WHEN 1 THEN 'On' WHEN 0 THEN 'Not-on' ELSE 'unknown' END AS b
  FROM documents LEFT JOIN labels USING (doc_id))
"""
