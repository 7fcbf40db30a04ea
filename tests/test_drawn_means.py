"""Bootstrap sums as products of blocks."""

from pyspark.sql import functions as F

from stipple.operators import resample as rs


def test_sums_of_draws_add_up_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(rs, "CELLS_A_BLOCK", 3)
    cells = [(g, 10 * g + i) for g in (1, 2) for i in range(8)] + [(3, 99)]
    frame = spark.createDataFrame(cells, "br int, cell long")
    curves = [(g, c, name, b, None if (c + (b or 0)) % 4 == 0 else c / 7 + (b or 0)) for g, c in cells for name, b in (("x", 0), ("x", 1), ("one", None))]
    picks = rs.cell_picks(frame, stratum="br", cell="cell", draws=20, seed=3)
    given = spark.createDataFrame(curves, "br int, cell long, name string, bin int, value double")
    rows = rs.drawn_means(given, picks, group="br", cell="cell", keys=["name", "bin"], value="value", draws=20).collect()
    assert len(rows) == 3 * 3 * 20
    weights = {(r["draw"], r["cell"]): r["w"] for r in rs.cell_draws(frame, stratum="br", cell="cell", draws=20, seed=3).collect()}
    assert sum(weights.values()) == 17 * 20 and picks.where(F.col("cell") == 99).count() == 20
    for r in rows:
        mine = [(weights.get((r["draw"], c), 0), v) for g, c, name, b, v in curves if (g, name, b) == (r["br"], r["name"], r["bin"])]
        assert abs(r["total"] - sum(w * v for w, v in mine if v is not None)) < 1e-9
        assert (r["weight"], r["valid"]) == (sum(w for w, _ in mine), sum(w for w, v in mine if v is not None))
