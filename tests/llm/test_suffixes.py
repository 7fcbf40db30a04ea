"""Suffix sorting of whole buckets, crowded buckets, and the size of what is written on the way."""

import os
import random
from urllib.parse import unquote, urlparse

import brute
import numpy as np
import pytest

from stipple.llm import suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def spliced(n: int, seed: int) -> list[tuple]:
    """Texts that share passages cut at different places: equal marks before different bytes."""
    rnd = random.Random(seed)
    fresh = lambda k: "".join(rnd.choice("abcdefgh ") for _ in range(k))
    passages = [fresh(900) for _ in range(8)]
    rows = []
    for d in range(n):
        p = rnd.choice(passages)
        i, j = rnd.randint(0, 200), rnd.randint(600, 900)
        rows.append((d, fresh(rnd.randint(0, 300)) + p[i:j] + fresh(rnd.randint(0, 300)), "en", "s", 0))
    return rows


@pytest.mark.parametrize("width", [150, 400])
def test_prefix_ranks_order_starts_by_their_bytes(width):
    rnd = np.random.default_rng(5)
    strings = [rnd.integers(0, 2, rnd.integers(width, width + 60)).astype(np.uint8).tobytes() for _ in range(20)]
    strings += [strings[0][: width + 3] + b"zzz", bytes(width + 9), bytes(width + 2)]
    data, at = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])
    keys = [s[i : i + width] for s in strings for i in range(len(s) - width + 1)]
    order = {k: n for n, k in enumerate(sorted(set(keys)))}
    assert [order[k] for k in keys] == suffixes.prefix_ranks(data, at, width).tolist()
    assert [keys.count(k) > 1 for k in keys] == suffixes.repeated_in(data, at, width).tolist()


@pytest.mark.parametrize("crowd", [1, 4096])
def test_crowded_buckets_keep_every_repeat(spark, awkward, crowd):
    rows = spliced(40, 6)
    got = {r["doc_id"]: tuple(r[1:]) for r in suffixes.repeats_removed(spark.createDataFrame(rows, DOCS), crowd=crowd).collect()}
    assert got == brute.byte_repeats(rows)
    rows, df = awkward
    got = {r["doc_id"]: tuple(r[1:]) for r in suffixes.repeats_removed(df, crowd=crowd).collect()}
    assert got == brute.byte_repeats(rows)


def test_written_tables_stay_below_four_times_the_texts(spark, monkeypatch):
    rows, sizes, write = spliced(150, 7), [], suffixes.written

    def spy(df):
        out = write(df)
        sizes.append(sum(os.path.getsize(unquote(urlparse(f).path)) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(suffixes, "written", spy)
    assert suffixes.repeats_removed(spark.createDataFrame(rows, DOCS)).count() == len(rows)
    assert sum(sizes) < 4 * sum(len(r[1]) for r in rows)
