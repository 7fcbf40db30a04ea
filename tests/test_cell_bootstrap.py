"""Cell bootstraps: picks stay in tasks."""

import re

from stipple.operators import resample as rs


def exploded_in_broadcasts(df):
    """Lines of a plan that explode rows below a broadcast exchange."""
    found, inside = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(re.match(r"[\s:+-]*", line).group())
        inside = None if inside is not None and depth <= inside else inside
        if inside is None and "BroadcastExchange" in line:
            inside = depth
        elif inside is not None and "Generate" in line:
            found.append(line)
    return found


def test_picks_are_never_broadcast(spark):
    """The planner counts an exploded table as small as its source: 2,000 draws of 2,000 cells looked smaller than the cells."""
    from stipple.catalog import load
    from stipple.catalog.registry import runnable

    cells = spark.range(200).selectExpr("id % 4 AS br", "id AS cell")
    picks = rs.cell_picks(cells, stratum="br", cell="cell", draws=50, seed=1)
    assert exploded_in_broadcasts(picks) == [] and picks.count() == 200 * 50
    for name in ("cell_bootstrap_bands", "cell_bootstrap_curves"):
        assert exploded_in_broadcasts(runnable(load()[name])(spark, "/root/testdata/sf0.001")) == [], name


def test_sums_of_own_picks_equal_sums_of_given_picks(spark, monkeypatch):
    """Blocks by number of the pick and blocks by cell, with small packs, give the same sums of every draw."""
    monkeypatch.setattr(rs, "CELLS_A_BLOCK", 3)
    monkeypatch.setattr(rs, "PICKS_A_PACK", 16)
    cells = [(s, 10 * s + i) for s in (1, 2) for i in range(7)] + [(3, 99)]
    frame = spark.createDataFrame(cells, "stratum int, cell long")
    rows = [(c % 2, c, b, None if (c + b) % 4 == 0 else c / 7 + b) for _, c in cells for b in (0, 1) if c != 13]
    given = spark.createDataFrame(rows, "grp long, cell long, bin int, value double")
    common = {"group": "grp", "cell": "cell", "keys": ["bin"], "value": "value", "draws": 20}
    picks = rs.cell_picks(frame, stratum="stratum", cell="cell", draws=20, seed=5)
    want = {(r["grp"], r["bin"], r["draw"]): r for r in rs.drawn_means(given, picks, **common).collect() if r["weight"]}
    own = rs.cell_drawn_means(given, frame, stratum="stratum", seed=5, cells_a_block=3, **common)
    got = {(r["grp"], r["bin"], r["draw"]): r for r in own.collect() if r["weight"]}
    assert got.keys() == want.keys() and len(got) > 60
    for k, r in got.items():
        assert (r["weight"], r["valid"]) == (want[k]["weight"], want[k]["valid"]) and abs(r["total"] - want[k]["total"]) < 1e-9
