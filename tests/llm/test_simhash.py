"""Fingerprints against plain counting, groups against all pairs."""

import random

import numpy as np
import xxhash
from lexigauge.llm import components, simhash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return [(d, f"{p:016x}", best.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))]


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(3))
    base = [" ".join(word() for _ in range(rnd.randint(1, 120))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(240):
        words = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = word()
        rows.append((1000 - i, rnd.choice([" ", "\n", " \x0b"]).join(words)))
    rows += [(5000, None), (5001, ""), (5002, " \t"), (5003, "\xa0 A"), (None, base[0]), (None, "Ünique one"), (7, base[7]), (7, base[7])]
    return rows


def test_groups(spark, monkeypatch):
    rows = corpus()
    want = plain_components(rows)
    for leaf, chunk in ((2000, 8000), (10, 5)):
        monkeypatch.setattr(simhash, "LEAF", leaf)
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        docs = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, simhash long").repartition(4)
        got = [(r.doc_id, f"{r.simhash & (2**64 - 1):016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_random_prints_meet_in_a_leaf():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, 3000).astype(np.uint64)
    flips = np.zeros(3000, np.uint64)
    for _ in range(4):
        flips ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    near = fps ^ flips
    trees = [simhash.grow(np.unique(simhash.window(fps, k)), 30)[0] for k in range(3)]
    met = set()
    for k, tree in enumerate(trees):
        home = {}
        for leaf, rows, own in simhash.visit(tree, simhash.window(fps, k)):
            home.update(dict.fromkeys(rows[own].tolist(), leaf))
        for leaf, rows, _ in simhash.visit(tree, simhash.window(near, k)):
            met |= {i for i in rows.tolist() if home[i] == leaf}
    assert len(met) == 3000


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


def test_components(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (101, 101), (None, 7), (200, 200)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200}
