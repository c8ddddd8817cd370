"""Collocations against plain counting of every phrase."""

import random
from collections import Counter

import pytest
from lexigauge.llm import collocations
from pyspark.sql import functions as F


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for mark in ",;:!?\n\x0b\x0c\r":
        low = low.replace(mark, ".")
    return [[w for w in piece.replace("\t", " ").split(" ") if w] for piece in low.split(".")]


def plain(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in plain_words(text):
            n[lang] += len(piece)
            for m in range(1, 5):
                for i in range(len(piece) - m + 1):
                    f[lang, tuple(piece[i : i + m])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for lang in n:
        scored = []
        for (g, p), a in f.items():
            if g != lang or len(p) < 2:
                continue
            inside = [q for (h, q) in f if h == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * f[lang, q] >= 80 * a for q in inside):
                continue
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, n=400):
    rnd = random.Random(seed)
    words = ["The", "of", "new", "York", "city", "é", "Ünd", "x\x00y", "\xa0", "a", "b", "c", "rare1", "Rare2"]
    weights = [30, 20, 6, 6, 6, 3, 3, 2, 2, 8, 8, 8, 1, 1]
    marks = [" "] * 12 + ["\t", ". ", ", ", "\n", "! ", "  ", "\r\n", "\x0b", "\x0c", "?;:"]
    rows = []
    for i in range(n):
        text = "".join(w + rnd.choice(marks) for w in rnd.choices(words, weights, k=rnd.randint(0, 40)))
        if i % 4 == 0:
            text += " in New York City hall, " * rnd.randint(1, 3)
        rows.append((rnd.choice(["en", "en", "en", "de", None, ""]), text))
    return rows + [("en", None), (None, ""), ("fr", "..."), ("fr", " \t"), ("de", "the of " * 4000)] + [("en", "Same text of the new york city a")] * 60


@pytest.mark.parametrize("least,top,block,slices", [(30, 2000, 12_000_000, 4096), (5, 7, 100, 3), (2, 30, 1, 4096)])
def test_phrases(spark, monkeypatch, least, top, block, slices):
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "SLICES", slices)
    rows = corpus(least, 120 if block == 1 else 400)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("x") for c in ("phrase", "f", "prefix", "slice", "a", "n")})
    got = collocations.collocations(docs.repartition(3), top, least).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, least, top)


def test_no_rows(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).collect() == []


def test_settings_stay(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    collocations.phrases(spark.createDataFrame(corpus(1, 20), "lang string, text string"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_products_beyond_64_bits(spark):
    row = spark.createDataFrame([(9 * 10**18, 9 * 10**18, 5 * 10**17)], "a long, l long, r long")
    score = F.expr("(CAST(a AS DECIMAL(28, 0)) * 2000000BD) div (CAST(l AS DECIMAL(28, 0)) + CAST(r AS DECIMAL(28, 0)))")
    assert row.select(score).first()[0] == 2_000_000 * 9 * 10**18 // (95 * 10**17)
