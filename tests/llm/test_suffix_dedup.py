import random

import numpy as np
from lexigauge.llm import suffix_dedup
from pyspark.sql import functions as F


def plain(rows):
    """All strings of 100 bytes in order of documents, the later of equal ones removed."""
    seen, out = set(), []
    done = {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        if (doc_id, text) not in done:
            gone = [False] * len(data)
            for a in range(len(data) - 99):
                s = data[a : a + 100]
                if s in seen:
                    gone[a : a + 100] = [True] * 100
                seen.add(s)
            done[doc_id, text] = gone
        gone = done[doc_id, text]
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def corpus():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rnd.randint(15, 60)) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [text(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a, b = sorted((rnd.randint(0, len(p)), rnd.randint(0, len(p))))
            p = rnd.choice([p, p[a:b]])
            if p and rnd.random() < 0.4:
                k = rnd.randrange(len(p))
                p = p[:k] + "#" + p[k + 1 :]
            parts += [p, text(rnd.randint(0, 10))]
        rows.append((i * 7 % 121, rnd.choice(["", " "]).join(parts)))
    rows += [(300, "a" * 777), (301, "ab" * 250), (302, "a" * 99), (303, "a" * 100), (304, rows[0][1]), (305, rows[0][1]), (305, rows[0][1])]
    return rows + [(400, None), (401, ""), (None, rows[5][1]), (403, "é" * 120), (404, "x" + "é" * 120)]


def check(spark, rows):
    docs = spark.createDataFrame([(a, b, a) for a, b in rows], "doc_id long, text string, n_spans long").repartition(5)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.drop_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_documents(spark):
    rows = corpus()
    assert sum(r[2] for r in plain(rows)) > 5000
    check(spark, rows)


def test_small_chunks_and_hot_grams(spark, monkeypatch):
    # workers import the module anew, so what they use is set through closures only for HOT
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 2000)
    check(spark, corpus())


def test_tasks_that_forget_hot_strings(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "REMEMBERED", 5)
    check(spark, corpus())


def test_bits_grow_with_the_grams(spark):
    n = 2_500_000
    grams = spark.range(n).select(F.xxhash64("id").alias("gram"))
    bits = suffix_dedup._bits(grams, n)
    others = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 200_000)
    assert suffix_dedup._has(bits, others).mean() < 0.08
    some = np.array([r.gram for r in grams.limit(500).collect()])
    assert suffix_dedup._has(bits, some).all()


def test_copies_of_hot_records_are_settled_where_they_are_met():
    rnd = np.random.default_rng(5)
    passage, met = rnd.integers(97, 123, 140, dtype=np.uint8), (suffix_dedup.Met(1000), suffix_dedup.Met(1000))
    sent = []
    for doc in range(200):
        _, first, number, offset = suffix_dedup.anchors(passage)
        places = [(doc, 0, a) for a in first.tolist()]
        sent.append([int(x[3]) for x in zip(*suffix_dedup.hot_rows(passage, places, first, first, number, offset, met), strict=True)])
    assert sum(sent[0]) == 41  # every string of the first
    assert not any(map(any, sent[1:])) and max(map(len, sent[1:])) <= len(first)


def test_suffixes_that_cannot_be_repeated_are_not_compared(monkeypatch):
    rnd = np.random.default_rng(6)
    n, shared = 3000, rnd.integers(0, 256, 150, dtype=np.uint8)
    rows = rnd.integers(0, 256, (n, 150), dtype=np.uint8)
    rows[[5, 700, 2900]] = shared
    rows[:, 50:82] = shared[50:82]  # one gram
    pairs, plain_of = [], suffix_dedup.Hashes.of
    monkeypatch.setattr(suffix_dedup.Hashes, "of", lambda self, a, local, k: pairs.append(len(a)) or plain_of(self, a, local, k))
    local = np.tile(np.arange(150), n)
    found = suffix_dedup.repeated(rows.ravel(), np.arange(n) * 150, local, np.zeros(n, np.int64))
    assert np.flatnonzero(found).tolist() == [700, 2900]
    assert sum(pairs) < 3 * n


def test_packed_texts_have_the_anchors_of_each():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab cé") for _ in range(rnd.choice([0, 99, 100, 101, 400, 70_000]))) for _ in range(60)] + [None, "a" * 300, "a" * 300]
    want = [
        (row, *(int(x) for x in run))
        for row, t in enumerate(texts)
        for a, d in suffix_dedup.stretches(t)
        for g, f, n, o in [suffix_dedup.anchors(d)]
        for run in zip(g, f + a, n, o, strict=True)
    ]
    got = []
    for data, row, start, ends in suffix_dedup.packs(texts):
        g, f, n, o = suffix_dedup.anchors(data, ends)
        piece = np.searchsorted(ends, f, "right")
        place = f + (start - np.append(0, ends[:-1]))[piece]
        got += [tuple(int(x) for x in run) for run in zip(row[piece], g, place, n, o, strict=True)]
    assert got == want


def test_stretches_of_long_texts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    rnd = np.random.default_rng(0)
    text = "".join(chr(97 + x) for x in rnd.integers(0, 3, 2000))
    pieces = list(suffix_dedup.stretches(text))
    starts = [a + i for a, d in pieces for i in range(len(d) - 99)]
    assert starts == list(range(1901))


def test_collisions_are_found(monkeypatch):
    data = np.frombuffer(bytes(np.random.default_rng(1).integers(0, 256, 3000, dtype=np.uint8)) * 2, np.uint8)
    at = np.array([0, 500, 3000, 3500, 100])
    segment = np.zeros(5, np.int64)
    want = [False, False, True, True, False]
    assert suffix_dedup.repeated(data, at, np.arange(len(data)), segment).tolist() == want
    monkeypatch.setattr(suffix_dedup, "_VALUES", np.ones_like(suffix_dedup._VALUES))  # all bytes alike
    assert suffix_dedup.repeated(data, at, np.arange(len(data)), segment).tolist() == want


def test_empty(spark):
    assert suffix_dedup.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
