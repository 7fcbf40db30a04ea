"""Links that only blocks find, candidates that fail, and the first shared key."""

import random

import brute
import numpy as np
import pytest
from test_contracts import DOCS

from stipple.llm import hamming


@pytest.mark.parametrize(("block", "percent_of_digests"), [(6, 75), (512, 75), (6, 50)])
def test_crowd_of_links_and_near_misses(spark, monkeypatch, block, percent_of_digests):
    """A crowd around one text at all similarities; with loose digests many candidates are no links and blocks meet again."""
    monkeypatch.setattr(hamming, "BLOCK", block)
    tight = hamming.met_in_blocks

    def loose(blocks, percent, max_distance, trees):
        return tight(blocks, min(percent, percent_of_digests), max_distance, trees)

    monkeypatch.setattr(hamming, "met_in_blocks", loose)
    rnd = random.Random(11)
    base = [f"w{rnd.random()}" for _ in range(90)]
    rows = []
    for k in range(45):
        words = list(base)
        for at in rnd.sample(range(90), rnd.randint(1, 4)):
            words[at] = f"x{rnd.random()}"
        rows.append((k, " ".join(words), "en", "s", 0))
    rows += [(100 + k, " ".join(base[3 * k : 3 * k + 50]), "en", "s", 0) for k in range(12)]
    got = {r["doc_id"]: r["component_id"] for r in hamming.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {d: c for d, (_, c) in brute.near_components(rows).items()}
    assert len(set(got.values())) > 3


def test_first_slot_is_a_shared_key():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        differs = rnd.random((1, hamming.SYMBOLS)) < 0.4
        slot = int(hamming.first_slot(differs)[0])
        chunks = differs[0].reshape(-1, hamming.CHUNK)
        if slot == hamming.SYMBOLS:
            assert chunks.sum(axis=1).min() > 1
            continue
        chunk, out = divmod(slot, hamming.CHUNK)
        assert np.delete(chunks[chunk], out).sum() == 0 and (chunks[:chunk].sum(axis=1) > 1).all()


def test_counted_keeps_every_copy():
    short = np.array([3, 3, 5, 9, 9, 9], np.uint16)
    other = np.array([3, 9, 9, 11], np.uint16)
    assert len(np.intersect1d(hamming.counted(short), hamming.counted(other), assume_unique=True)) == 3
    assert len(hamming.counted(np.empty(0, np.uint16))) == 0
