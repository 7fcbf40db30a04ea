"""Results against plain-Python versions, and every awkward case of the docstrings."""

import binascii
import hashlib
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stipple.llm import divergence, exact, fuzzy_lines, hamming, mixture, packing, recompression, shared, suffixes, templates, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_exact_decisions(awkward):
    rows, df = awkward
    groups = {}
    for d in rows:
        groups.setdefault(d[1] or "", []).append(d[0])
    got = {r["doc_id"]: r for r in exact.exact_decisions(df).collect()}
    assert len(got) == len(rows)
    for text, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert {r["doc_id"] for r in exact.drop_copies(df).collect()} == {max(ids) for ids in groups.values()}


def test_near_components(awkward):
    rows, df = awkward
    want = brute.near_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in hamming.near_duplicates(df).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_near_blocks_find_links_without_the_pivot(spark):
    """A chain in which only neighbours are linked: no single member is near to all."""
    rnd = random.Random(2)
    words = [f"t{rnd.random()}" for _ in range(200)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 60]), "en", "s", 0) for k in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in hamming.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {d: c for d, (_, c) in brute.near_components(rows).items()} and set(got.values()) == {0}


def test_signature_keys_meet_under_the_distance():
    rnd = np.random.default_rng(4)
    for _ in range(200):
        a = rnd.integers(0, 1 << 16, hamming.SYMBOLS, dtype=np.uint16)
        b = a.copy()
        at = rnd.choice(hamming.SYMBOLS, hamming.MAX_DISTANCE, replace=False)
        b[at] ^= rnd.integers(1, 1 << 16, len(at), dtype=np.uint16)
        chunks = (a != b).reshape(-1, hamming.CHUNK).sum(axis=1)
        assert chunks.min() <= 1


def test_byte_repeats(awkward):
    rows, df = awkward
    got = {r["doc_id"]: tuple(r[1:]) for r in suffixes.repeats_removed(df).collect()}
    assert got == brute.byte_repeats(rows)


@pytest.mark.parametrize("depth", [9, 81])
def test_suffix_ranks_order_all_suffixes(spark, depth):
    rnd = random.Random(3)
    strings = [[rnd.choice([1, 2, 3]) for _ in range(rnd.randint(0, 40))] for _ in range(8)] + [[1] * 30, [1, 2] * 15, []]
    df = spark.createDataFrame([(i, [s]) for i, s in enumerate(strings)], "seg long, s array<array<long>>")
    ranks = {r["seg"]: r["ranks"][0] for r in suffixes.suffix_ranks(df, depth).collect()}
    suffixes_ = sorted((tuple(s[j : j + depth]), ranks[i][j]) for i, s in enumerate(strings) for j in range(len(s)))
    for (x, p), (y, q) in zip(suffixes_, suffixes_[1:]):
        assert p <= q and (x == y or p < q)


def test_word_repeats(awkward):
    rows, df = awkward
    got = {r["doc_id"]: tuple(r[1:]) for r in recompression.passages_removed(df).collect()}
    assert got == brute.word_repeats(rows)


def test_symbols_of_a_passage_survive_its_context():
    rng = np.random.default_rng(1)
    h = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    for _ in range(300):
        p = h(recompression.WINDOW)
        names = [set(recompression.symbols(np.concatenate([h(20), p, h(20)]), np.array([0, 90]))[0].tolist()) for _ in range(2)]
        assert names[0] & names[1]


def test_quality_counts(awkward):
    rows, df = awkward
    got = {r["doc_id"]: r for r in divergence.judged(df).collect()}
    for d, text, *_ in rows:
        n, chars, symbols, dup, rep = brute.quality_base(text)
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n)
        assert not (r["base_failed"] and r["kept"])


def test_divergence_drops_symbol_soup(spark):
    rnd = random.Random(1)
    prose = [" ".join(rnd.choice(["the", "of", "and", "river", "stone", "under", "tall", "to"]) for _ in range(150)) for _ in range(20)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(prose)] + [(99, " ".join("x%$#*&" + str(i) for i in range(150)), "en", "s", 0)]
    kept = {r["doc_id"]: r["kept"] for r in divergence.judged(spark.createDataFrame(rows, DOCS)).select("doc_id", "kept").collect()}
    assert not kept.pop(99)
    assert [d for d in kept if not kept[d] and 100 * brute.quality_base(prose[d])[4] <= 20 * 150] == []


def brute_lines(rows):
    first, sets, out = {}, {}, {}
    lines = {d[0]: [(k, x.strip(" \t\n\r\x0b\x0c")) for k, x in enumerate((d[1] or "").split("\n"))] for d in rows}
    for d in sorted(lines):
        for no, x in lines[d]:
            if x:
                first.setdefault(x, (d, no))
                sets[x] = {x[i : i + 10] for i in range(len(x) - 9)} if len(x) > 10 else {x}
    parent = {x: x for x in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(sets, key=first.get)
    for k, x in enumerate(order):
        for y in order[:k]:
            both = len(sets[x] & sets[y])
            if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((root(x), root(y)), key=first.get)
                parent[b] = a
    for d, own in lines.items():
        own = [(no, x) for no, x in own if x]
        gone = [no for no, x in own if first[root(x)] != (d, no)]
        out[d] = (len(own), len(gone), gone)
    return out


def test_fuzzy_lines(awkward):
    rows, df = awkward
    got = {r["doc_id"]: tuple(r[1:]) for r in fuzzy_lines.line_report(df).collect()}
    assert got == brute_lines(rows)


def test_tokens_are_the_tokenizers_own(awkward):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = [d[1] or "" for d in awkward[0]] + ["it's we'll 'S x's", "1²3½ a_b ..!!,", "<|endoftext|> <|x", "Ǆ ŉ ß ẞ İ Σς", "c\x1cd\x85e\xa0f", "é,–a,é .é «a»", "a,b;c--d"]
    ids, at = packing.WordTokens(packing.VOCABULARY).of(*shared.buffers(pa.array(texts)))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t


def check_packing(rows, got, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for d, text in texts:
        seq = plain.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in parts] == [
            (k, s, min(4096, len(seq) - s)) for k, s in enumerate(range(0, len(seq), 4096))]
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(np.array(seq[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts])[:-1]] and sum(r["length"] for r in parts) <= 4096
    assert len(by_sequence) <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_packing_is_gapless_and_tight(spark, awkward):
    rows, _ = awkward
    many = [(k, " ".join(["word"] * (1 + k * 37 % 900)), "en", "s", 0) for k in range(20_000, 20_200)]
    rows = [*rows, *many]
    check_packing(rows, packing.pack(spark.createDataFrame(rows, DOCS).repartition(5)).collect(), [(r[0], r[1]) for r in rows])


def test_fullest_is_the_best_combination():
    rnd = random.Random(6)
    for _ in range(60):
        counts = {rnd.randint(1, 60): rnd.randint(1, 3) for _ in range(6)}
        used = packing.fullest(dict(counts), 64)
        reach = {0}
        rest = dict(counts)
        rest[max(counts)] -= 1
        for length, n in rest.items():
            for _ in range(n):
                reach |= {x + length for x in reach if x + length <= 64 - max(counts)}
        assert sum(k * v for k, v in used) == max(counts) + max(reach)
        assert all(v <= counts[k] for k, v in used)


def test_mixture_meets_its_targets(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join("ab" for _ in range(rnd.randint(20, 60))) + rnd.choice(["", " | x", " @"]), rnd.choice(["en", "en", "en", "de"]),
             rnd.choice(["big"] * 6 + ["small", "mid"]), 0) for i in range(4000)]
    got = mixture.mixed_rows(spark.createDataFrame(rows, DOCS)).toPandas()
    assert len(got) == 4000
    got["expected"] = got["n_tokens"] * got["probability"]
    total = got["n_tokens"].sum()
    assert abs(got["expected"].sum() / total - 0.5) < 1e-6
    by_topic = got.groupby("topic")["expected"].sum()
    by_lang, lang_now = got.groupby("lang")["expected"].sum(), got.groupby("lang")["n_tokens"].sum()
    assert by_topic.max() / by_topic.min() < 1.001
    assert abs(by_lang["en"] / by_lang["de"] - (lang_now["en"] / lang_now["de"]) ** 0.5) < 0.01
    assert abs((got["n_tokens"] * got["kept"]).sum() / total - 0.5) < 0.05


def test_toxicity_learns_and_holds_out(spark):
    rnd = random.Random(4)
    vocab = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(1500):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(20, 80))]
        bad = rnd.random() < 0.3
        if bad:
            for _ in range(4):
                words[rnd.randrange(len(words))] = rnd.choice(["vile", "rotten", "foul"])
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 0, int(bad)))
    rows += [(5000, None, "en", "s", 0), (5001, "", None, None, 0)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (binascii.crc32(str(i).encode()) % 3 == 1) for i, _, _ in labels)
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert 0 <= got[5000]["score"] <= 1 and got[5000]["score"] == got[5001]["score"]
    assert all(abs(r["score"] - 0.5) < 1e-9 for r in toxicity.toxicity(docs, marks.limit(0)).collect())
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["predicted"] == 0}


def test_main_text(spark):
    shell = ("<html><head><title>T</title><script>var a='</p>'</script></head><body><div class=top><p>Site words</p></div><nav><ul><li>Home<li>News</ul></nav>"
             "{}<div><p>Ask our staff</p></div><footer>&copy; us</footer></body></html>")
    pages = [(k, "http://h.example/" + str(k), shell.format(f"<div><p>Story {k} has&nbsp;text &amp; more<br>of it<p>Second  para {k}</div>"
                                                            f"<div id=comments><p>I say {k}</p></div>")) for k in range(30)]
    pages += [(100, "http://h.example/c", shell.format("<article><h1>Same</h1><p>a <b>b</b>c</article>"))] * 7
    pages += [(200, None, None), (201, "", "no tags at all"), (None, "http://h.example/x", "<p>unclosed <i>one<p>two &lt;3 &am")]
    got = {}
    for r in templates.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    for k in range(30):
        assert got[k] == [f"Story {k} has text & more of it\nSecond para {k}"]
    assert got[100] == ["Same\na bc"] * 7
    assert got[200] == [""] and got[201] == ["no tags at all"] and got[None] == ["unclosed one\ntwo <3 &am"]


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


ALL = {
    "exact": exact.exact_decisions, "near": hamming.near_duplicates, "bytes": suffixes.repeats_removed, "words": recompression.passages_removed,
    "rules": divergence.judged, "lines": fuzzy_lines.line_report, "mixture": mixture.mixed_rows, "packing": packing.pack,
    "copies": exact.drop_copies, "sample": mixture.sample_to_targets,
}


@pytest.mark.parametrize("name", ALL)
def test_empty_and_clashing_tables(spark, clashing, name):
    rows, frame = clashing
    assert ALL[name](frame.limit(0)).collect() == []
    got = ALL[name](frame).collect()
    ids = [r["doc_id"] for r in got]
    if name in ("bytes", "words", "rules", "mixture", "packing"):
        assert sorted(ids, key=str) == sorted([d for d, _ in rows], key=str)
    elif name == "near":
        assert sorted(ids, key=str) == sorted(["None", "None", *map(str, range(1, 7))], key=str) or len(ids) == 8
    elif name in ("exact", "lines"):
        assert len(ids) == 8
    else:
        assert got and set(got[0].asDict()) == set(frame.columns)
    if name == "copies":
        assert sorted(ids) == [1, 3, 5, 6]
