"""The trie of rebuilt conversations against dictionaries of tuples, with shards of a few turns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from stipple.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0), role, digest, text))
    convs = {c: [(t[1], t[3]) for t in sorted(ts)] for c, ts in convs.items()}
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(convs.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
        ends[p].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, ms in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(ms) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, ms in members.items())


def found(spark, rows, **more):
    return sorted(tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_nodes(spark.createDataFrame(rows, SCHEMA), **more).collect())


def corpus(seed, n=120):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        words = ["hi", "hello ü", "x" * rnd.randint(0, 40)]
        for k in range(rnd.choice([0, 1, 2, 3, 9, 12])):
            rows.append((c, rnd.choice([k, k, k, None]) if rnd.random() < 0.1 else k, rnd.choice(["user", "user", "assistant", None]), rnd.choice(words)))
    copies = [(1000 + c, k, "user", "same") for c in range(60) for k in range(12)]  # one conversation many times
    return rows + copies


@pytest.mark.parametrize("seed,turns", [(1, 25), (2, 7), (3, 100_000), (4, 60)])
def test_nodes_equal_dictionaries(spark, seed, turns):
    rows = corpus(seed)
    assert found(spark, rows, turns_a_shard=turns) == brute(rows)


def test_deep_shared_path_over_shards(spark):
    """Each conversation goes one turn further than the one before; every boundary lies on the same path."""
    rows = [(5 * c, k, "user", str(k)) for c in range(40) for k in range(c + 1)]
    assert found(spark, rows, turns_a_shard=40) == brute(rows)


def test_awkward_rows(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (-3, 0, "a", "b"), (-5, 0, "a", "b"), (-5, 1, "c", "d" * 200_000),
            (7, 0, "a", "b"), (7, 0, "a", "b"), (2, 5, "ab", "c"), (3, 5, "a", "bc"), (10**15, 0, "z", "z")]
    assert found(spark, rows) == brute(rows) == found(spark, rows, turns_a_shard=3)
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA + ", part string, node string, depth int")
    assert sorted(tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_nodes(frame).collect()) == brute(rows)
    assert found(spark, []) == [] == found(spark, [(None, 1, "a", "b")])


def test_parentheses_against_a_stack():
    rnd = random.Random(5)
    for n in (1, 3, 40, 3000):
        bits, depth = [1], 1
        left = n - 1
        while left or depth > 1:
            if left and (depth == 1 or rnd.random() < 0.55):
                bits.append(1)
                depth, left = depth + 1, left - 1
            else:
                bits.append(0)
                depth -= 1
        bits.append(0)
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        tree = prefix_trie.Parentheses(np.array(bits, bool))
        assert tree.findclose(tree.opens).tolist() == [want[i] for i in tree.opens]
        assert tree.leaf_pairs[-1] == sum(a == 1 and b == 0 for a, b in zip(bits, bits[1:]))


def test_shards_of_every_cut(spark):
    """The same nodes whatever the shards are."""
    rows = corpus(9, 40)
    want = brute(rows)
    for turns in (3, 11, 37):
        assert found(spark, rows, turns_a_shard=turns) == want
