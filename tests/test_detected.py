"""Detected profiles, sketches of distinct words, counts taken while writing."""

import pytest
from pyspark.sql import functions as F

from lexigauge.fixed_values import READABILITY_METRICS
from lexigauge.operators import clean as P
from lexigauge.operators import language as L
from lexigauge.operators import text_profile as T
from lexigauge.plans import profile_detected, profile_detected_datasets
from lexigauge.session import materialize, new_folder
from lexigauge.sources import append_features, read_features
from tests.conftest import physical

ROWS = [
    (1, "a", "Кошка и собака были в доме. Очень большие животные!", "ru"),
    (2, "a", "The cat and the dog were in the house. Considerable animals!", "en"),
    (3, "a", "Это длинный текст о преобразовании предложений. Да.", "ru"),
    (4, "b", "Extraordinary considerations. And the others.", "en"),
    (5, "b", None, "en"),
    (6, None, "123 ...", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, dataset_name string, text string, lang string")


@pytest.fixture(scope="module")
def languages(docs):
    return materialize(L.fit_profile(docs), "languages")


def test_rules_follow_the_language_found(docs, languages):
    """As if the labels had been given."""
    got = {r.doc_id: r for r in profile_detected(docs, languages).collect()}
    want = {r.doc_id: r for r in T.profile_documents(docs, ["doc_id"], lang="lang").collect()}
    assert {i: r.detected_lang for i, r in got.items()} == {1: "ru", 2: "en", 3: "ru", 4: "en", 5: None, 6: None}
    for i, w in want.items():
        for c in w.asDict():
            assert got[i][c] == (pytest.approx(w[c]) if isinstance(w[c], float) else w[c]), (i, c)


def test_datasets(docs, languages):
    got = {r.dataset_name: r for r in profile_detected_datasets(docs, languages).collect()}
    want = {r.dataset_name: r for r in T.profile_datasets(docs, "dataset_name", lang="lang").collect()}
    assert got.keys() == want.keys()
    for name, w in want.items():
        for c in w.asDict():
            assert got[name][c] == (pytest.approx(w[c]) if isinstance(w[c], float) else w[c]), (name, c)
    # most words of `a` are Russian
    assert got["a"][READABILITY_METRICS[0]] is not None


def test_no_text_is_shuffled(spark, docs, languages, tmp_path):
    docs.write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    words = L.word_weights(read, languages)
    plan = physical(profile_detected(read, languages, words=words))
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "text" not in line


def test_sketches_are_stored_and_merged(spark, docs):
    many = docs.unionByName(spark.range(4000).select((F.col("id") + 100).alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("dataset_name"), F.concat(F.lit("w"), F.col("id") % 1500).alias("text"), F.lit("en").alias("lang")))
    parts = T.unique_word_sketches(many, ["dataset_name", "lang"])
    path = new_folder(spark, "features")
    append_features(T.profile_datasets(docs, "dataset_name"), path)
    append_features(parts, path)
    stored = read_features(spark, path).filter("words_sketch IS NOT NULL")
    merged = T.merged_sketches(stored, ["dataset_name"])
    whole = T.unique_word_sketches(many, ["dataset_name"]).toDF("name", "whole")
    both = merged.join(whole, F.col("dataset_name").eqNullSafe(F.col("name")))
    same = {r[0]: r[1] for r in both.select("dataset_name", T.same_words(F.col("words_sketch"), F.col("whole"))).collect()}
    assert same == {"a": True, "b": True, None: True}
    one = T.unique_word_sketches(docs, []).crossJoin(merged.filter("dataset_name = 'a'").toDF("name", "other"))
    assert not one.select(T.same_words(F.col("words_sketch"), F.col("other"))).first()[0]
    exact = {r.dataset_name: r.n_unique_words for r in T.unique_words_by(many, "dataset_name").collect()}
    found = {r[0]: r[1] for r in merged.select("dataset_name", T.sketched_words(F.col("words_sketch"))).collect()}
    assert found[None] == exact[None] == 1  # the number
    for name, n in exact.items():
        assert abs(found[name] - n) <= 4 * 1.04 / 64 * n
    total = T.merged_sketches(stored, []).select(T.sketched_words(F.col("words_sketch"))).first()[0]
    assert abs(total - 1527) <= 4 * 1.04 / 64 * 1527


def test_counts_are_taken_on_the_way(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "{}"), (3, None), (4, "fine")], "row_id long, c1 string")
    rows, seen = P.observed(P.clean_rows(df, "row_id", ["c1"]))
    assert P.kept(rows).count() == 2
    got = sorted(map(tuple, P.observed_accounting(spark, seen).collect()))
    assert got == sorted(map(tuple, P.row_accounting(P.clean_rows(df, "row_id", ["c1"])).collect())) == [("invalid_cell", 2), ("kept", 2)]
