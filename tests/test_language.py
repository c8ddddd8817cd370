import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigauge.functions import analysis_language
from lexigauge.operators import language as L
from lexigauge.session import broadcast_within, materialize
from tests.conftest import optimized

TRAINING = [
    ("the cat and the dog were in the house with the other animals", "en"),
    ("this is a text about nothing that matters to anyone", "en"),
    ("кошка и собака были в доме с другими животными", "ru"),
    ("это текст ни о чём который никому не важен", "ru"),
    ("die Katze und der Hund waren im Haus mit den anderen Tieren", "de"),
    ("unlabelled", None),
]


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.createDataFrame(TRAINING, "text string, lang string")
    profile = materialize(L.fit_profile(docs), "profile")
    return docs, profile


def plain_grams(word):
    padded = f" {word} "
    return [*word, *(padded[i : i + 2] for i in range(len(padded) - 1)), *(padded[i : i + 3] for i in range(len(padded) - 2))]


def plain_words(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def plain_profile():
    counts = {}
    for text, lang in TRAINING:
        if lang:
            counts.setdefault(lang, Counter()).update(g for w in plain_words(text) for g in plain_grams(w))
    kinds = len({g for c in counts.values() for g in c})
    weights = {}
    for lang, c in counts.items():
        total = sum(c.values()) + kinds
        weights[lang] = {g: round(1000 * math.log((n + 1) / total)) for g, n in c.items()} | {"": round(1000 * math.log(1 / total))}
    return weights


def plain_scores(text, weights):
    grams = [g for w in plain_words(text) for g in plain_grams(w)]
    if not any(g in w for g in grams for w in weights.values()):
        return {lang: None for lang in weights}
    return {lang: sum(w.get(g, w[""]) for g in grams) for lang, w in weights.items()}


def test_profile_has_every_gram(trained):
    _, profile = trained
    got = {}
    for r in profile.collect():
        got.setdefault(r.lang, {})[r.gram] = r.weight
    assert got == plain_profile()


TEXTS = [(1, "the other house"), (2, "собака и кошка"), (3, "und der Hund"), (4, "123 ..."), (5, None), (6, ""), (7, "the qzqzq the"), (8, "漢字"), (9, "a a a b")]


def test_detection(spark, trained):
    _, profile = trained
    new = spark.createDataFrame(TEXTS, "doc_id long, text string")
    found = {r[0]: r[1:] for r in L.detect_language(new, profile, "doc_id").collect()}
    assert found[1] == ("en", "en") and found[2] == ("ru", "ru") and found[3] == ("de", "en")
    # no n-gram of these is known
    assert found[4] == found[5] == found[6] == found[8] == (None, None)


@pytest.mark.parametrize("limit,share", [(128 << 20, 1 / 4096), (0, 1 / 4096), (0, 0.05)])
def test_scores(spark, trained, monkeypatch, limit, share):
    """By broadcast and by shuffles, with and without hot words and n-grams."""
    docs, profile = trained
    monkeypatch.setattr(L, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(L, "HOT_SHARE", share)
    keyed = docs.select((100 + F.monotonically_increasing_id()).alias("doc_id"), "text")
    new = keyed.unionByName(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    weights = plain_profile()
    rows = {r.doc_id: r.text for r in new.collect()}
    for r in L.language_scores(new, profile, "doc_id").collect():
        assert {s.lang: s.score for s in r.scores} == plain_scores(rows.pop(r.doc_id), weights)
    assert not rows


def test_words_are_scored_once(spark, trained):
    docs, profile = trained
    words = L.word_weights(docs, profile)
    assert words.count() == len({w for t, _ in TRAINING for w in plain_words(t)})
    keyed = docs.select(F.monotonically_increasing_id().alias("id"), "text")
    plan = optimized(L.language_scores(keyed, profile, "id", words=words))
    assert "(?=" not in plan  # no n-grams are taken of texts


def test_profile_without_labels(spark):
    none = spark.createDataFrame([("text", None)], "text string, lang string")
    profile = materialize(L.fit_profile(none), "none")
    assert profile.count() == 0
    new = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert {r.detected_lang for r in L.detect_language(new, profile, "doc_id").collect()} == {None}


def test_routing(spark):
    df = spark.createDataFrame([("ru",), ("de",), (None,)], "lang string")
    assert [r[0] for r in df.select(analysis_language(F.col("lang"))).collect()] == ["ru", "en", "en"]


def test_broadcast_is_checked(spark):
    small = spark.range(5)
    assert "ResolvedHint" in broadcast_within(small, 5)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in broadcast_within(small, 4)._jdf.queryExecution().analyzed().toString()
