"""Exact tests, multiplicity, bootstrap units and quantiles."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stipple.functions.columns import inverse_normal
from stipple.operators import inference as nf
from stipple.operators import resample as rs
from stipple.operators import skew


def comparison(spark, a, b):
    return spark.createDataFrame([("c", a, b)], "comparison_id string, values_a array<double>, values_b array<double>")


def test_exact_permutation(spark):
    r = nf.exact_permutation(comparison(spark, [1.0, 2.0, 3.0], [4.0, 5.0, 6.0])).first()
    assert (r["difference"], r["partitions"]) == (-3.0, 20) and r["p_raw"] == pytest.approx(0.1)
    assert nf.exact_permutation(comparison(spark, [1.0, 1.0, 1.0], [1.0, 1.0, 1.0])).first()["p_raw"] == 1.0


def brute_p(a, b):
    """Every partition, in whole multiples of 1e-9."""
    values, na = [round(v * 10**9) for v in (*a, *b)], len(a)
    seen, total, tails = sum(values[:na]), sum(values), [0, 0, 0]
    for chosen in itertools.combinations(values, na):
        s = sum(chosen)
        tails[0] += s <= seen
        tails[1] += s >= seen
        tails[2] += 1
    return seen / 1e9 / na - (total - seen) / 1e9 / len(b), tails[2], min(1.0, 2 * min(tails[:2]) / tails[2])


def test_exact_permutation_meets_in_the_middle(spark):
    """Sums that all differ, ties, lists of unequal length; the state table stays at 2 ** (n / 2)."""
    rng = random.Random(6)
    cases = [([round(rng.random(), 9) for _ in range(na)], [round(rng.random() * k, 9) for _ in range(nb)]) for na, nb, k in ((9, 9, 1.3), (3, 12, 1), (7, 10, 2), (1, 1, 1), (1, 8, 3))]
    cases += [([1.0, 2.0, 2.0, 3.0], [2.0, 2.0, 5.0]), ([0.5] * 6, [0.5] * 5), ([-4.0, 1.5], [2.25, -7.0, 3.0]), ([1e6 + 0.1, 2e6], [3e6 + 0.3])]
    df = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(cases)], "comparison_id string, values_a array<double>, values_b array<double>")
    for r in nf.exact_permutation(df).collect():
        difference, partitions, p = brute_p(*cases[int(r["comparison_id"])])
        assert r["partitions"] == partitions and r["p_raw"] == pytest.approx(p, rel=1e-12) and r["difference"] == pytest.approx(difference, rel=1e-9, abs=1e-9)
    c = spark.createDataFrame([("x", 20, [round(rng.random(), 9) for _ in range(20)])], "comparison_id string, na int, v array<double>")
    assert nf.half_states(c.withColumn("v", F.col("v").cast("array<decimal(28,9)>")), "comparison_id").count() == 2 * 2**10
    assert nf.exact_permutation(df.limit(0)).collect() == []


def test_holm(spark):
    df = spark.createDataFrame(list(zip("abcd", [0.01, 0.04, 0.03, 0.2])), "comparison_id string, p_raw double")
    assert [r["p_holm"] for r in nf.holm(df).orderBy("comparison_id").collect()] == pytest.approx([0.04, 0.09, 0.09, 0.2])


def test_inverse_normal(spark):
    df = spark.createDataFrame([(0.5,), (0.975,), (0.01,), (0.999,)], "p double")
    assert [r[0] for r in df.select(inverse_normal(F.col("p"))).collect()] == pytest.approx([0.0, 1.959963985, -2.326347874, 3.090232306], abs=1e-7)


def test_block_units_never_cross_a_join(spark):
    u = rs.resampling_units(spark, frames=20, length=5, stratum_frames=10)
    assert u.count() == 16 and u.where("floor(source_frame / 5) <> floor(target_frame / 5)").count() == 0
    with pytest.raises(ValueError):
        rs.block_plan(spark, last_frame=F.lit(19), stratum_frames=10, lengths=[3], draws=2, seed=1)


def test_block_plan_keeps_every_stratum_full(spark):
    p = rs.block_plan(spark, last_frame=F.lit(19), stratum_frames=10, lengths=[5, 2], draws=7, seed=1)
    got = p.groupBy("length", "draw", "stratum").agg(F.sum("w").alias("w")).select("length", "w").distinct().collect()
    assert {(r[0], r[1]) for r in got} == {(5, 2), (2, 5)}


def test_cell_draws_keep_stratum_sizes(spark):
    cells = spark.createDataFrame([(i, i % 3) for i in range(31)], "cell int, br int")
    d = rs.cell_draws(cells, stratum="br", cell="cell", draws=5, seed=3).groupBy("draw", "br").agg(F.sum("w").alias("w")).collect()
    assert len(d) == 15 and all(r["w"] == (11 if r["br"] == 0 else 10) for r in d)


def test_interval_needs_enough_valid_draws(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", float(i) if i < 90 else None) for i in range(100)], "k string, v double")
    r = {x["k"]: x for x in rs.interval(df, ["k"], "v", total=100).collect()}
    assert r["a"]["low"] == pytest.approx(np.percentile(range(100), 2.5)) and r["b"]["low"] is None and r["b"]["valid_draws"] == 90


@pytest.mark.parametrize("slices", [1, 7, 4096])
def test_exact_quantiles_match_numpy(spark, slices):
    rng = random.Random(1)
    data = {"big": [rng.choice([0.0, 1.0, 2.5]) for _ in range(500)] + [rng.gauss(0, 9) for _ in range(300)], "one": [4.0], "flat": [2.0] * 9}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r["k"], r["prob"]): r["quantile"] for r in skew.exact_quantiles(df, ["k"], "v", probs, slices=slices).collect()}
    for k, vs in data.items():
        for p in probs:
            assert got[(k, p)] == pytest.approx(np.quantile(vs, p))


@pytest.mark.parametrize("slices", [1, 3, 4096])
def test_exact_quantiles_with_endless_values(spark, slices):
    """NaN, infinities and ranges beyond a double in groups that are cut into slices."""
    inf, nan = float("inf"), float("nan")
    data = {"nan": [float(i) for i in range(60)] + [nan], "ends": [-inf, -inf, *map(float, range(40)), inf], "wide": [(-1.7e308, 1.7e308)[i % 2] * (1 - i / 99) for i in range(60)],
            "all": [inf, nan, -inf], "close": [1.0 + i * 2.0**-52 for i in range(50)], "none": [nan] * 3}
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    got = {(r["k"], r["prob"]): r["quantile"] for r in skew.exact_quantiles(df, ["k"], "v", probs, slices=slices, ordered=10).collect()}
    for k, vs in data.items():
        vs = sorted(vs, key=lambda v: (v != v, v))
        for p in probs:
            at = (len(vs) - 1) * p
            low, high = vs[int(np.floor(at))], vs[int(np.ceil(at))]
            want = low if at == np.floor(at) or not np.isfinite(low) and np.isfinite(high) else high if not np.isfinite(high) else low + (high - low) * (at - np.floor(at))
            assert got[(k, p)] == pytest.approx(want, nan_ok=True)
    ints = spark.createDataFrame([(i,) for i in range(101)], "v long")
    assert [r["quantile"] for r in skew.exact_quantiles(ints, [], "v", [0.5], ordered=10).collect()] == [50.0]


def test_drawn_counts_equal_numpy(spark):
    """Draws as arrays against weights times blocks, with a last stratum cut short and a component that is missing."""
    rng = np.random.default_rng(4)
    lengths, frames, draws = [5, 2], 27, 40
    rows = [("s", g, c, f, b, int(rng.integers(0, 90))) for g in ("On", "Not-on") for c in ("total", "background") for f in range(frames) for b in range(4)
            if not (g == "On" and c == "background" and b == 3)]
    counts = spark.createDataFrame(rows, "sample_id string, grp string, component string, frame int, bin int, n long")
    blocks = rs.block_sums(counts, length=5).withColumn("length", F.lit(5)).unionByName(rs.block_sums(counts, length=2).withColumn("length", F.lit(2)))
    plan = {"last_frame": F.lit(frames - 1), "stratum_frames": 10, "lengths": lengths, "draws": draws, "seed": 3}
    picks = {(r["length"], r["stratum"]): r["picks"] for r in rs.block_picks(spark, **plan).collect()}
    assert {k: len(v[0]) for k, v in picks.items()} == {(5, 0): 2, (5, 1): 2, (5, 2): 2, (2, 0): 5, (2, 1): 5, (2, 2): 4}
    drawn = rs.drawn_counts(blocks, rs.block_picks(spark, **plan), ["sample_id", "grp"], stratum_frames=10)
    for r in drawn.collect():
        for side, component in (("t", "total"), ("b", "background")):
            want = np.zeros(draws, int)
            for stratum in range(3) if r["scope"] == "full" else [int(r["scope"][1:])]:
                for d, chosen in enumerate(picks[r["length"], stratum]):
                    for k in chosen:
                        first = stratum * 10 + k * r["length"]
                        want[d] += sum(n for _, g, c, f, b, n in rows if (g, c, b) == (r["grp"], component, r["bin"]) and first <= f < first + r["length"]
                                       and (c != "total" or f % r["length"] != r["length"] - 1))
            assert r[side] == want.tolist()
    splits = rs.drawn_splits(drawn, ["sample_id", "grp", "length", "scope"], n_bins=6, width=0.1).collect()
    assert len(splits) == 16 and all(len(r["bins"]) == 6 and len(r["fit"]) == draws for r in splits)
    for r in splits:
        t, b = np.array([x["t"] for x in r["bins"]], float), np.array([x["b"] for x in r["bins"]], float)
        t, b = t / t.sum(axis=0), b / b.sum(axis=0)
        beta = np.clip((t[4:] * b[4:]).sum(axis=0) / np.where((b[4:] ** 2).sum(axis=0) > 0, (b[4:] ** 2).sum(axis=0), np.nan), 0, 1)
        for d, fit in enumerate(r["fit"]):
            assert fit["beta"] is None or fit["beta"] == pytest.approx(beta[d])


def test_bootstrap_groups_equal_numpy(spark):
    rng = np.random.default_rng(5)
    cells = [(g, f"{g}:{c % 2}", c) for g, n in (("a", 9), ("b", 1)) for c in range(100 * (g == "b"), 100 * (g == "b") + n)]
    curves = [(g, c, b, float(rng.normal()), None if c == 3 else float(rng.normal())) for g, _, c in cells for b in range(3)]
    w = rs.cell_weights(spark.createDataFrame([(s, c) for _, s, c in cells], "stratum string, cell int"), stratum="stratum", cell="cell", draws=30, seed=2)
    weights = {r["cell"]: np.array(r["w"]) for r in w.collect()}
    own = spark.createDataFrame([(g, c) for g, _, c in cells], "grp string, cell int")
    got = rs.bootstrap_groups(spark.createDataFrame(curves, "grp string, cell int, bin int, x double, y double"), w.join(own, "cell"), group="grp", cell="cell",
                              values=["x", "y"], cells_a_block=4).collect()
    assert len(got) == 12 and all(sum(weights[c].sum() for g, _, c in cells if g == name) == 30 * n for name, n in (("a", 9), ("b", 1)))
    for r in got:
        at = 3 if r["name"] == "x" else 4
        mine = [(weights[c[1]], c[at]) for c in curves if (c[0], c[2]) == (r["grp"], r["bin"]) and c[at] is not None]
        assert r["means"] == pytest.approx((sum(w * v for w, v in mine) / sum(w for w, _ in mine)).tolist())


def test_numbered_is_a_dense_order_for_one_hot_key(spark):
    df = spark.createDataFrame([("hot", i * 37 % 1009) for i in range(1009)] + [("b", 5), ("b", 1)], "k string, v int").repartition(7)
    out = skew.numbered(df, ["k"], ["v"]).orderBy("k", "v").collect()
    assert [r["rank"] for r in out] == [1, 2, *range(1, 1010)]


@pytest.mark.parametrize("slices", [2, 4096])
def test_quantiles_of_large_groups_write_few_of_their_values(spark, monkeypatch, slices):
    """With ``reread`` only values of slices with a wanted rank are counted and written; results are those of the plain way."""
    inf, nan, rng, written = float("inf"), float("nan"), random.Random(5), []
    data = {"big": [rng.gauss(0, 1) for _ in range(4000)], "few": [float(i % 3) for i in range(900)], "one": [4.0], "ends": [-inf, inf, nan, *map(float, range(700))], "none": [nan] * 3}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in [*vs, None]], "k string, v double")
    probs, cut = [0.0, 0.1, 0.5, 0.9, 1.0], skew.cut_lineage

    def counted(rows):
        out = cut(rows)
        written.append(out.count())
        return out

    monkeypatch.setattr(skew, "cut_lineage", counted)
    get = lambda **kw: {(r["k"], r["prob"]): r["quantile"] for r in skew.exact_quantiles(df, ["k"], "v", probs, slices=slices, ordered=500, **kw).collect()}
    got, most = get(reread=True), max(written)
    if slices > 2:  # a rank stands in either half
        assert most < 1000
    want = get()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], nan_ok=True) for k in want)
    ints = spark.createDataFrame([(i,) for i in range(101)], "v long")
    assert [r["quantile"] for r in skew.exact_quantiles(ints, [], "v", [0.5], ordered=10, reread=True).collect()] == [50.0]
