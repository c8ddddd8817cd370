"""Counts against plain ones, the model against one of dictionaries, its two ways against each other."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from lexigauge.llm import quality
from lexigauge.llm.queries import op11_quality
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(hit)


def plain_grams(text):
    joined = " " * 4 + "".join(w + " " for w in WORDS.findall(text or ""))
    return [joined[i : i + 5] for i in range(len(joined) - 4)]


def plain_model(texts):
    """{gram: log p}, {context: log weight} in millionths."""
    counts = {5: Counter(g for t in texts for g in plain_grams(t))}
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    p, weight = {"": 1 / (len(counts[1]) + 1)}, {}
    for k in range(1, 6):
        n = [sum(c == i for c in counts[k].values()) for i in range(5)]
        d = [0, 0.5, 1.0, 1.5]
        if all(n[1:]):
            y = n[1] / (n[1] + 2 * n[2])
            for i in (1, 2, 3):
                fair = i - (i + 1) * y * n[i + 1] / n[i]
                d[i] = fair if 0 < fair <= i else i / 2
        after = defaultdict(list)
        for g, c in counts[k].items():
            after[g[:-1]].append(c)
        for context, cs in after.items():
            weight[context] = sum(d[min(c, 3)] for c in cs) / sum(cs)
        for g, c in counts[k].items():
            p[g] = (c - d[min(c, 3)]) / sum(after[g[:-1]]) + weight[g[:-1]] * p[g[1:]]
    return p, weight


def plain_log(gram, p, weight):
    if gram in p:
        return round(math.log(p[gram]) * 1e6)
    return (round(math.log(weight[gram[:-1]]) * 1e6) if gram[:-1] in weight else 0) + plain_log(gram[1:], p, weight)


def corpus(seed=3):
    rnd = random.Random(seed)
    part = ["th", "er", "on", "an", "é", "in", "Ü", "st", "x\x00", "\U0001f600", "#", "a&b"]
    word = lambda: "".join(rnd.choice(part[: rnd.choice([4, 8, 12])]) for _ in range(rnd.randint(1, 4)))
    vocabulary = [word() for _ in range(60)]
    rows = []
    for i in range(150):
        words = rnd.choices(vocabulary, k=rnd.randint(0, 60))
        if i % 5 == 0:
            words += words[-rnd.randint(1, 12) :] * 2
        rows.append((i, rnd.choice(["en", "de", None]), "".join(w + rnd.choice([" ", " ", "\n", "\t ", "\x0b", "\xa0 ", "\r\n"]) for w in words)))
    rows += [(500, "en", None), (501, "fr", ""), (502, "fr", " \n"), (503, "xx", "one"), (504, "en", "same line here\n" * 30), (None, "en", "a b c d e f g h i j k l"), (7, "en", rows[7][2]), (7, "en", rows[7][2])]
    return rows + [(600, "de", "".join(rnd.choice(vocabulary) + " " for _ in range(20_000)))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, lang string, text string").withColumns({c: F.lit("x") for c in ("kept", "n_words", "gram", "id", "number", "sum", "row")}).repartition(3).cache()


def test_base(spark, docs, monkeypatch):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect()}
    want = set()
    for i, _, text in corpus():
        n = plain_base(text)
        want.add((i, *n, n[0] < 10 or 100 * n[4] > 20 * n[0]))
    assert got == want


def test_model(spark, docs):
    model = quality.fit(docs)
    unpack = lambda g: "".join(chr(int.from_bytes(g[i : i + 3], "little")) for i in range(0, len(g), 3))
    rows = corpus()
    for lang in ("en", "de", "und", "xx"):
        p, weight = plain_model([t for _, g, t in rows if (g or "und") == lang])
        got = {unpack(bytes(r.gram)): r.log_p for r in model.probs.filter(F.col("model") == f"0:{lang}").collect()}
        assert got.keys() == p.keys()
        assert all(abs(v - math.log(p[g]) * 1e6) < 1 for g, v in got.items())
        got = {unpack(bytes(r.gram)): r.log_b for r in model.weights.filter(F.col("model") == f"0:{lang}").collect()}
        assert got.keys() == weight.keys()
        assert all(abs(v - math.log(weight[g]) * 1e6) < 1 for g, v in got.items())


def test_probabilities_sum_to_one():
    rows = [t for _, g, t in corpus() if g == "en"]
    p, weight = plain_model(rows)
    letters = {g for g in p if len(g) == 1}
    for context in ("", " ", "th", "erth", " th"):
        whole = sum(math.exp(plain_log(context + c, p, weight) / 1e6) for c in letters) + math.exp(plain_log(context + "?", p, weight) / 1e6)
        assert abs(whole - 1) < 1e-4


def test_scores_of_other_texts(spark, docs, monkeypatch):
    """Grams and a language that the model lacks, by arrays and by joins; long texts in slices."""
    model = quality.fit(docs.filter("doc_id < 100"))
    others = spark.createDataFrame(
        [(1, "en", "zzz there qqq一 " * 9, 5), (2, "en", "theron anin", 6), (3, "tlh", "not known at all", 7), (4, None, "eré ther\ninst", 8), (5, "en", None, 9), (6, "tlh", None, 9), (7, "de", "an ther " * 3000, 1)],
        "id long, lang string, text string, sum long",
    ).repartition(2)
    by_arrays = sorted(quality.score(others, model).collect(), key=str)
    monkeypatch.setattr(quality, "MODEL_ENTRIES", 0)
    assert sorted(quality.score(others, model).collect(), key=str) == by_arrays
    p, weight = plain_model([t for i, g, t in corpus() if g == "en" and i is not None and i < 100])
    (one,) = [r for r in by_arrays if r.id == 1]
    grams = plain_grams("zzz there qqq一 " * 9)
    assert one.n_grams == len(grams)
    assert abs(one.log_p - sum(plain_log(g, p, weight) for g in grams)) <= len(grams)


def test_folds(spark):
    """Every text is scored by what the other fold holds, copies with the same."""
    rows = [(i, "en" if i % 3 else None, f"text {i % 20} " + "the ther there " * (i % 4)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(2)
    for r in quality.score(docs, quality.fit(docs, 2)).collect():
        _, lang, text = rows[r.doc_id]
        fold = zlib.crc32(text.encode()) % 2
        p, weight = plain_model([t for _, g, t in rows if g == lang and zlib.crc32(t.encode()) % 2 != fold])
        grams = plain_grams(text)
        assert abs(r.log_p - sum(plain_log(g, p, weight) for g in grams)) <= len(grams)


def test_slices(monkeypatch):
    text = " ".join(f"w{i}é" for i in range(500)).encode()
    monkeypatch.setattr(quality, "SLICE", 50)
    cut = [p for _, p in quality._sequences(text)]
    grams = [h for p in cut for h in quality.hashes(p, 5).tolist()]
    monkeypatch.setattr(quality, "SLICE", 10**9)
    ((_, whole),) = quality._sequences(text)
    assert len(cut) > 5 and grams == quality.hashes(whole, 5).tolist()


def test_repeated_words():
    rnd = np.random.default_rng(2)
    for n in (0, 5, 6, 7, 40, 200):
        for words in (2, 3, 30):
            ids = rnd.integers(0, words, n)
            assert quality.repeated_words(ids) == plain_base(" ".join(map(str, ids)))[4]


def test_bands(spark):
    rows = [("en", i, 2.0 + i % 7 / 8) for i in range(300)] + [("en", 1000, 9.0), ("en", 1001, 0.1), ("de", 1, 5.0)]
    frame = spark.createDataFrame(rows, "lang string, i long, log_perplexity double")
    found = {r.lang: (r.middle, r.deviation) for r in quality.bands(frame).collect()}
    # the median is 2.375, the middle distance from it 0.25; one document has none, so the floor holds
    assert found == {"en": (2375, 250), "de": (5000, 1000 * quality.FLOOR)}


def test_junk_is_rejected_and_prose_is_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    rnd = random.Random(1)
    junk = [(10**6 + i, "en", " ".join("".join(rnd.choice("qxzjkvw0123456789@^~") for _ in range(7)) for _ in range(80))) for i in range(3)]
    # the commonest words in new orders: far likelier than prose
    junk += [(10**6 + 10 + i, "en", " ".join(rnd.choice(["of", "the", "to", "and", "in", "is", "that", "on", "are", "for"]) for _ in range(1200))) for i in range(3)]
    docs = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    out = quality.judge(docs).cache()
    assert {(r.base_failed, r.kept) for r in out.filter("doc_id >= 1000000").collect()} == {(False, False)}
    middle = {r.lang: r.middle for r in quality.bands(out.filter("NOT base_failed")).collect()}
    sides = {r.doc_id: r.log_perplexity * 1000 > middle[r.lang] for r in out.filter("doc_id >= 1000000").collect()}
    assert sides == {i: i < 10**6 + 10 for i in sides}
    judged = out.filter("doc_id < 1000000 AND NOT base_failed")
    assert judged.filter("kept").count() >= 0.9 * judged.count()


def test_no_rows(spark, sf_dir):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert quality.judge(none).collect() == []
    empty = spark.createDataFrame([(1, None, None), (2, "en", "")], "doc_id long, lang string, text string")
    assert {(r.doc_id, r.base_failed, r.kept, r.perplexity) for r in quality.judge(empty).collect()} == {(1, True, False, None), (2, True, False, None)}
    assert op11_quality(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
