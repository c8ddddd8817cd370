"""A vocabulary beyond the broadcast limit: no word of a text is shuffled."""

import pytest
from pyspark.sql import functions as F

from lexigauge.operators import language as L
from lexigauge.session import materialize
from tests.conftest import physical
from tests.test_language import TEXTS, TRAINING, plain_profile, plain_scores


@pytest.mark.parametrize("given", [False, True])
def test_rare_words_are_scored_where_they_stand(spark, monkeypatch, given):
    docs = spark.createDataFrame(TRAINING, "text string, lang string")
    profile = materialize(L.fit_profile(docs), "profile")
    keyed = docs.select((100 + F.monotonically_increasing_id()).alias("doc_id"), "text")
    made = spark.range(2000).select((1000 + F.col("id")).alias("doc_id"), F.concat(F.lit("the und "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    new = keyed.unionByName(spark.createDataFrame(TEXTS, "doc_id long, text string")).unionByName(made)
    words = L.word_weights(new, profile) if given else None
    # room for the n-grams and some words, not for all
    monkeypatch.setattr(L, "BROADCAST_BYTES", 1000 * (L.ROW_BYTES + 8 * 5))
    weights = plain_profile()
    scores = L.language_scores(new, profile, "doc_id", words=words)
    rows = {r.doc_id: r.text for r in new.collect()}
    for r in scores.collect():
        assert {s.lang: s.score for s in r.scores} == plain_scores(rows.pop(r.doc_id), weights)
    assert not rows
    assert "hashpartitioning(word" not in physical(scores) and "hashpartitioning(_cold" not in physical(scores)
