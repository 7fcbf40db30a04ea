"""The pipeline on a small corpus: each stage against plain Python on what its predecessor kept."""

import hashlib
import random

import brute
import pytest
from test_contracts import DOCS, check_packing

import __spark_entry__
import corpus_pipeline
from stipple.llm import registry


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rnd = random.Random(8)
    vocab = [f"v{k}" for k in range(400)]
    rows = brute.awkward_documents()
    labels = []
    for i in range(20_000, 20_600):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(15, 60))]
        bad = rnd.random() < 0.3
        if bad:
            for _ in range(5):
                words[rnd.randrange(len(words))] = rnd.choice(["vile", "rotten"])
        rows.append((i, " ".join(words), "en", "s1", 0))
        labels.append((i, 1, int(bad)))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), dict((i, y) for i, _, y in labels)


def test_stages_in_order(spark, corpus, tmp_path):
    folder, toxic = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = ([tuple(r) for r in before.collect()], docs.collect())
    before, after = seen["toxicity"]
    kept = {r["doc_id"] for r in after}
    assert sum(d not in kept for d, y in toxic.items() if y) > 0.9 * sum(toxic.values())
    assert all(d[0] in kept for d in before if toxic.get(d[0]) != 1)
    before, after = seen["exact_dedup"]
    largest = {}
    for d in before:
        largest[d[1] or ""] = max(d[0], largest.get(d[1] or "", -1))
    assert sorted(r["doc_id"] for r in after) == sorted(largest.values())
    before, after = seen["near_dedup"]
    assert sorted(r["doc_id"] for r in after) == sorted(d for d, (_, c) in brute.near_components(before).items() if c == d)
    before, after = seen["mixing"]
    chance = brute.mixture(before)
    drawn = {d[0]: int(hashlib.md5(f"mix:{d[0]}".encode()).hexdigest()[:13], 16) / 16**13 for d in before}
    wanted = {d[0]: chance.get((d[3] or "(none)", d[2] or "(none)", brute.topic(d[1] or "")), 0.5) for d in before}
    sure = {d for d in drawn if abs(drawn[d] - wanted[d]) > 1e-5}
    assert {r["doc_id"] for r in after} & sure == {d for d in sure if drawn[d] < wanted[d]} and 0 < len(after) < len(before) and len(sure) > 0.9 * len(before)
    before, after = seen["packing"]
    check_packing(before, after, [(d[0], d[1]) for d in before])


def test_empty_corpus(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in names if q.startswith("op") and q[2].isdigit()}
    assert "pipeline" in names and set(registry.load()) <= names
    assert {"op1_source_mixture", "op3_distribution_divergence", "op6_exact_dedup", "op12_conversation_prefix_trie"} <= set(__spark_entry__.oracle_sql())
