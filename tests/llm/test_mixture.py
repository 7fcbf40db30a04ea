"""Marginals of the sample where cells reach probability one, and where a target asks for more than there is."""

import random

import brute
import pytest
from pyspark.sql import functions as F
from test_contracts import DOCS

from stipple.llm import mixture


def corpus(rare):
    rnd = random.Random(3)
    tails = [""] * (3 * rare) + [" | x", " @"]
    return [(i, " ".join("ab" for _ in range(rnd.randint(20, 60))) + rnd.choice(tails), rnd.choice(["en", "en", "en", "de"]),
             rnd.choice(["big"] * 6 + ["small", "mid"]), 0) for i in range(4000)]


@pytest.mark.parametrize("rare", [9])
def test_marginals_are_met_with_cells_at_one(spark, rare):
    docs = spark.createDataFrame(corpus(rare), DOCS)
    got = mixture.mixed_rows(docs).toPandas()
    assert (got["probability"] == 1).any()  # the case that a later bound spoils
    got["expected"] = got["n_tokens"] * got["probability"]
    total = got["n_tokens"].sum()
    assert abs(got["expected"].sum() / total - 0.5) < 1e-6
    for dim in ("source", "lang"):
        now, then = got.groupby(dim)["n_tokens"].sum() ** 0.5, got.groupby(dim)["expected"].sum()
        assert (then / then.sum() - now / now.sum()).abs().max() < 1e-4
    own, then = got.groupby("topic")["n_tokens"].sum(), got.groupby("topic")["expected"].sum()
    scarce = [t for t in own.index if own[t] < total / 6]
    assert len(scarce) == (0 if rare == 1 else 2) and all(abs(then[t] - own[t]) < 1e-3 * total for t in scarce)
    rest = [t for t in own.index if t not in scarce]
    assert max(then[rest]) / min(then[rest]) < 1.001
    for r in mixture.attained(docs).collect():
        assert abs(r["attained"] - r["reachable"]) < 1e-4
        assert abs(r["attained"] - then.get(r["value"], r["attained"] * total / 2) / (total / 2)) < 1e-6
        assert r["settled"] and r["rounds"] > 0


def test_probabilities_equal_a_plain_rake(spark):
    rows = corpus(9)
    want = brute.mixture(rows)
    for r in mixture.mixed_rows(spark.createDataFrame(rows, DOCS)).select("source", "lang", "topic", "probability").distinct().collect():
        assert abs(r["probability"] - want[r["source"], r["lang"], r["topic"]]) < 2e-6


def test_many_cells_are_raked_alike(spark):
    slim = spark.createDataFrame(corpus(9), DOCS).select(*mixture.dims("source", "lang", "text"), mixture.n_words(F.col("text")).alias("n_tokens"))
    one, many = ({tuple(r)[:3]: r["probability"] for r in mixture.chances_of(slim, 0.5, None, n)[0].collect()} for n in (1000, 2))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 5e-5 for k in one)


def test_own_targets_and_values_without_one(spark):
    def targets(cells):
        out = mixture.tempered(cells)
        out["__source"] = cells.sparkSession.createDataFrame([("big", 3.0), ("small", 1.0), ("mid", 0.0)], "__source string, target double")
        return out

    docs = spark.createDataFrame(corpus(1), DOCS)
    got = mixture.mixed_rows(docs, share=0.1, targets=targets).toPandas()
    got["expected"] = got["n_tokens"] * got["probability"]
    then = got.groupby("source")["expected"].sum()
    assert then["mid"] == 0 and abs(then["big"] / then["small"] - 3) < 1e-3 and abs(then.sum() / got["n_tokens"].sum() - 0.1) < 1e-6
    assert {r["settled"] for r in mixture.attained(docs, share=0.1, targets=targets).collect()} == {True}


def test_targets_that_exclude_each_other_are_reported(spark):
    """Only German pages of one source, whose targets ask for half of all German and little of the source."""
    rows = [(i, "ab " * 20, "de" if i % 4 == 0 else "en", "a" if i % 4 == 0 else "b", 0) for i in range(400)]
    frame = lambda spark, dim, pairs: spark.createDataFrame(pairs, f"{dim} string, target double")

    def targets(cells):
        s = cells.sparkSession
        return {"__source": frame(s, "__source", [("a", 1.0), ("b", 9.0)]), "__lang": frame(s, "__lang", [("de", 5.0), ("en", 5.0)]),
                "__topic": frame(s, "__topic", [("prose", 1.0)])}

    assert {r["settled"] for r in mixture.attained(spark.createDataFrame(rows, DOCS), share=0.2, targets=targets).collect()} == {False}


def test_columns_with_helper_names(spark):
    rows = [(*r, "x", "y") for r in corpus(1)[:300]]
    names = ", `__source` string, `__draw` string"
    got = mixture.sample_to_targets(spark.createDataFrame(rows, DOCS + names))
    plain = mixture.sample_to_targets(spark.createDataFrame([r[:5] for r in rows], DOCS))
    assert got.columns[-2:] == ["__source", "__draw"] and sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in plain.collect())
