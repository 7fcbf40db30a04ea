"""Plain-Python versions of the operators' contracts, and a small table of awkward documents."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def awkward_documents(seed: int = 5, copies: int = 12) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empties, repeats, near copies, shared passages, long runs."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeghilmnorstuäéß") for _ in range(rnd.randint(1, 9))) for _ in range(900)]

    def prose(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))

    base, passage = prose(130), prose(70)
    texts = [None, "", " ", "\n\t \n", "one", "one two three four", "One two three four", "one two three four five",
             "a a a a a a a a a a a a", "x" * 1500, "ab " * 700, prose(30), "É é word tied 日本 😀 ok", "tail\x00nul b"]
    texts += [base] * copies + [base.upper(), base + " end", "start " + base]
    for k in range(copies):
        words = base.split(" ")
        for at in rnd.sample(range(130), 1 + k // 2):
            words[at] = f"edit{k}x{at}"
        texts.append(" ".join(words))
    texts += [prose(40) + " " + passage + " " + prose(rnd.randint(5, 60)) for _ in range(6)]
    texts += [prose(25) + " " + " ".join(passage.split(" ")[:49]) + " " + prose(25) for _ in range(2)]
    texts += [prose(25) + " " + " ".join(passage.split(" ")[:50]) + " " + prose(25) for _ in range(2)]
    texts += [passage + "\n" + prose(3) + "\n" + passage, "lines here\nlines here\nlines here\n" + prose(12), prose(4000)]
    texts += ["y" * 900 + prose(20), "y" * 700 + prose(30), "ab " * 300 + prose(9)]
    rnd.shuffle(texts)
    ids = rnd.sample(range(10_000), len(texts))
    return [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s0", "s0", "s1", None]), len(t or "")) for i, t in zip(ids, texts)]


def shingles(text: str | None) -> set:
    w = WORD.findall(lower_az(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_components(docs: list[tuple]) -> dict[int, tuple[int, int]]:
    """doc_id: (set size, smallest doc_id reachable)."""
    sets = {d[0]: shingles(d[1]) for d in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    where: dict[tuple, list[int]] = {}
    for d in ids:
        for s in sets[d]:
            where.setdefault(s, []).append(d)
    for a in ids:
        for b in {x for s in sets[a] for x in where[s] if x > a}:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in ids}


def byte_repeats(docs: list[tuple], width: int = 400) -> dict[int, tuple]:
    """doc_id: (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen: dict[bytes, int] = {}
    data = {d[0]: (d[1] or "").encode() for d in docs}
    for t in data.values():
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]] = seen.get(t[i : i + width], 0) + 1
    out = {}
    for d, t in data.items():
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[d] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def word_repeats(docs: list[tuple], width: int = 50) -> dict[int, tuple]:
    """doc_id: (n_words, n_removed, kept_sha256)."""
    words = {d[0]: WORD.findall(d[1] or "") for d in docs}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def quality_base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count: dict[tuple, int] = {}
    for i in range(len(w) - 4):
        count[tuple(w[i : i + 5])] = count.get(tuple(w[i : i + 5]), 0) + 1
    inside = [False] * len(w)
    for i in range(len(w) - 4):
        if count[tuple(w[i : i + 5])] > 1:
            inside[i : i + 5] = [True] * 5
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(inside)


def topic(text):
    low = text.lower()
    if not text:
        return "empty"
    for name, found in (("tabular", " | " in text), ("legal", "licensed under" in low or "copyright" in low),
                        ("contact", "@" in text or "http" in text), ("symbolic", "###" in text or "%%%" in text)):
        if found:
            return name
    return "prose"


def met(target, rows, least):
    """The factor under which min(tokens, factor * weight) of the rows adds up to the target, by halving."""
    if least([t for t, _ in rows], [w * 1e12 for _, w in rows]) <= target:
        return 1e12
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2 if hi < 1 else (max(lo, 1e-12) * hi) ** 0.5
        lo, hi = (mid, hi) if least([t for t, _ in rows], [w * mid for _, w in rows]) < target else (lo, mid)
    return hi


def mixture(rows, share=0.5, rounds=400):
    """Probability by (source, lang, topic) of a bounded rake: every step solves a value's factor by halving."""
    cells = {}
    for _, text, lang, source, *_ in rows:
        key = (source or "(none)", lang or "(none)", topic(text or ""))
        cells[key] = cells.get(key, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    cells = {k: n for k, n in cells.items() if n}
    least = lambda caps, ws: sum(min(a, b) for a, b in zip(caps, ws))
    budget, goals = share * sum(cells.values()), []
    for d, power in enumerate((0.5, 0.5, 0)):
        own = {}
        for k, n in cells.items():
            own[k[d]] = own.get(k[d], 0) + n
        f = met(budget, [(n, n**power) for n in own.values()], least)
        goals.append({v: min(n, f * n**power) for v, n in own.items()})
    weight = dict(cells)
    for _ in range(rounds):
        for d in range(3):
            for v, goal in goals[d].items():
                mine = [k for k in cells if k[d] == v]
                f = met(goal, [(cells[k], weight[k]) for k in mine], least)
                for k in mine:
                    weight[k] *= min(f, 1e6)
        gap = max(abs(sum(min(cells[k], weight[k]) for k in cells if k[d] == v) - goal) for d in range(3) for v, goal in goals[d].items())
        if gap < 1e-9 * budget:
            break
    return {k: min(1.0, weight[k] / n) for k, n in cells.items()}
