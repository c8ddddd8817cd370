"""Likeness against sets of paragraphs, and the order of documents."""

import hashlib
import random
import re

from pyspark.sql import functions as F
from lexigauge.llm import fingerprints


def plain_paragraphs(text):
    return {p.strip(" ") for p in re.findall(r"[^\n]{250,}?[.!?](?=[ \t\n\x0b\f\r])|[^\n]+", text)}


def plain(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        m = len(t) // 4
        edited = t[: len(t) - m] + following[:m]
        near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        a = plain_paragraphs(t)
        yield i, len(t), hashlib.sha256(edited.encode()).hexdigest(), near(a, plain_paragraphs(edited)), near(a, plain_paragraphs(following))


def corpus():
    rnd = random.Random(6)
    sentence = lambda: " ".join(rnd.choice(["aé", "bee", "cé", "d"]) + str(rnd.randint(0, 40)) for _ in range(rnd.randint(3, 20))) + rnd.choice(". ! ?".split())
    lines = [" ".join(sentence() for _ in range(rnd.randint(1, 9))) for _ in range(200)]
    rows = [(i * 37 % 1009, "\n".join(rnd.choice(lines) for _ in range(rnd.choice([0, 1, 2, 5, 20, 60])))) for i in range(150)]
    rows += [(2000, None), (2001, ""), (2002, rows[1][1]), (None, "null id"), (2003, rows[3][1]), (2003, rows[3][1]), (2004, "\n".join(f"line {k}" for k in range(1500)))]
    return rows


def test_documents(spark, monkeypatch):
    rows = corpus()
    want = sorted(((i, n, s, round(x, 9), round(y, 9)) for i, n, s, x, y in plain(rows)), key=str)
    docs = spark.createDataFrame([(a, b, a) for a, b in rows], "doc_id long, text string, n_chars long").repartition(5)
    for ranges in (256, 3):
        monkeypatch.setattr(fingerprints, "RANGES", ranges)
        out = fingerprints.compare_versions(docs).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in out), key=str) == want
    shown = fingerprints.compare_versions(docs).select("doc_id", fingerprints.written(F.col("cells")).alias("f")).collect()
    prints = dict(zip([r.doc_id for r in shown], [r.f for r in shown]))
    assert prints[2002] == prints[rows[1][0]] and prints[2000] == prints[2001] == "0" * 34 * fingerprints.CELLS
    assert fingerprints.compare_versions(docs.limit(0)).count() == 0
    one = fingerprints.compare_versions(docs.filter("doc_id = 2004")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_peeling_retries_and_never_lies(spark):
    """Differences of any size are recovered exactly or not at all, and exactly after retries."""
    df = spark.range(60).select(
        F.expr("transform(sequence(1, cast(id as int) + 1), x -> xxhash64(x))").alias("a"), F.expr("transform(sequence(1, cast(id as int) + 1, 3), x -> xxhash64(x * 2))").alias("b")
    )
    apart = fingerprints.peel(fingerprints.subtract(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))))
    out = df.select("a", "b", apart.alias("p"), fingerprints._group_difference(F.col("a"), F.col("b")).alias("g")).collect()
    for r in out:
        want = (len(set(r.a) - set(r.b)), len(set(r.b) - set(r.a)))
        assert tuple(r.g) == want and (r.p is None or tuple(r.p) == want)
    assert all(r.p for r in out[:8]) and not out[59].p


def test_texts_without_lines_and_sentence_ends(spark):
    """A text whose edited version keeps three quarters of it shares paragraphs with that; none is too long."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvwyé") for _ in range(rnd.randint(1, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    texts = [words(n) for n in (60, 61, 80, 81, 150, 151, 400, 401, 3000, 3001)]  # from about 300 characters
    texts += [words(n)[:20] + ". " + words(n) for n in (110, 111, 300, 301)]  # an early end, then none
    texts += ["".join(chr(rnd.randint(0x4E00, 0x9000)) for _ in range(n)) for n in (300, 301, 5000, 5001)]  # no blanks either
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = {r.doc_id: r for r in fingerprints.compare_versions(docs).collect()}
    assert [i for i in out if out[i].near_edited <= out[i].near_next] == [] and all(r.near_next == 0 for r in out.values())
    assert all(out[i].near_edited > 0.5 for i, t in enumerate(texts) if len(t) > 4000)
    pieces = [r.p for r in docs.select(F.explode(F.regexp_extract_all("text", F.lit(fingerprints.PARAGRAPH), F.lit(0))).alias("p")).collect()]
    assert max(map(len, pieces)) <= fingerprints.MOST and sum(map(len, pieces)) == sum(map(len, texts))
    # words put in at the start of a long line move few cuts behind them
    n = docs.filter("doc_id = 9").select(fingerprints.paragraphs(F.col("text")).alias("a"), fingerprints.paragraphs(F.concat(F.lit("some more words "), "text")).alias("b"))
    r = n.select(F.size("a").alias("a"), F.size(F.array_intersect("a", "b")).alias("shared")).first()
    assert r.shared > 0.7 * r.a


def test_long_lines_are_cut_in_linear_time(spark):
    runs = [c * 200_000 for c in ("a", " ", ".", "a ", "é", "。", ". ", ".\t ")]
    found = spark.createDataFrame([(r,) for r in runs], "text string").select(F.size(fingerprints.paragraphs(F.col("text"))).alias("n")).collect()
    assert all(0 < r.n <= 3000 for r in found)
