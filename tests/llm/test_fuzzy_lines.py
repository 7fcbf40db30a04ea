"""Lines that only blocks can link, and the recall of the bands."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_contracts import DOCS, brute_lines

from stipple.llm import fuzzy_lines, shared


@pytest.mark.parametrize("block", [4, 256])
def test_crowded_bands_end_with_every_link(spark, monkeypatch, block):
    """One band for all lines, so pairs of every kind meet: clusters, chains and lines of their own."""
    monkeypatch.setattr(fuzzy_lines, "BLOCK", block)

    def one_band(lines):
        return lines.selectExpr("7L as band", "id")

    monkeypatch.setattr(fuzzy_lines, "band_keys", one_band)
    rnd = random.Random(5)
    text = [rnd.choice("abcdefghij ") for _ in range(1000)]
    lines = ["".join(text[6 * k : 6 * k + 120]) for k in range(25)]  # a chain: neighbours are linked, the ends are not
    for _ in range(8):
        base = [rnd.choice("klmnopqrst") for _ in range(80)]
        lines += ["".join(base[:c] + ["Z"] + base[c:]) for c in (0, 80)] + ["".join(base)]
    lines += ["é" * 30 + str(k) * 9 for k in range(9)] + ["x", "y"]
    rows = [(k, line, "en", "s", 0) for k, line in enumerate(lines)]
    got = {r["doc_id"]: tuple(r[1:]) for r in fuzzy_lines.line_report(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_lines(rows)


def bands(lines):
    values, line = fuzzy_lines.shingles(*shared.buffers(pa.array(lines)))
    return fuzzy_lines.minima(values, line, len(lines)).reshape(len(lines), -1, fuzzy_lines.BAND)


@pytest.mark.parametrize("length", [40, 90, 200])
def test_recall_of_the_bands(length):
    """Of random line pairs at a similarity of 0.80 to 0.90, at least 0.98 share a band."""
    rnd, pairs = random.Random(length), []
    while len(pairs) < 1500:
        a = [rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(length)]
        b = list(a)
        for _ in range(rnd.randint(1, 3)):
            b[rnd.choice([rnd.randrange(3), rnd.randrange(length), length - 1])] = "Q"
        x, y = ({"".join(t[i : i + 10]) for i in range(length - 9)} for t in (a, b))
        if 0.80 <= len(x & y) / len(x | y) <= 0.90:
            pairs.append(("".join(a), "".join(b)))
    left, right = bands([a for a, _ in pairs]), bands([b for _, b in pairs])
    assert np.mean((left == right).all(axis=2).any(axis=1)) >= 0.98


def test_short_and_long_lines_have_minima():
    lines = ["a", "é" * 9, "ab" * 5, "z" * 100_000, "".join(map(str, range(30_000)))]
    m = bands(lines)
    assert m.shape[0] == len(lines) and (m != np.iinfo(np.uint64).max).all()
    assert len(np.unique(m[0])) == len(np.unique(m[3])) == 1
