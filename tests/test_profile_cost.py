"""Texts are split once, sentences compared in batches, tokens built without a second pass."""

import random

from pyspark.sql import functions as F

from checks import derived
from lexigauge.fixed_values import SENTENCE, WORD
from lexigauge.functions.homogeneity import adjacent_similarities, adjacent_similarities_in_batches
from lexigauge.operators import text_profile as T
from lexigauge.plans import detected
from tests.conftest import optimized


def test_counts_collect_no_matches_but_sentences(spark):
    df = spark.createDataFrame([(1, "d", "a b. c", "en")], "doc_id long, dataset_name string, text string, lang string")
    for made in (T.text_counts(df, "text", "lang"), T.profile_documents(df, ["doc_id"], lang="lang"), T.profile_datasets(df, "dataset_name", lang="lang")):
        assert optimized(made).count(SENTENCE) == 1 and WORD not in optimized(made)
    assert optimized(detected._counts_by_both_rules(df, "text")).count(SENTENCE) == 1


def test_batches_give_the_same_similarities(spark, monkeypatch):
    rnd = random.Random(1)
    sents = lambda n: ["".join(rnd.choice("abcdé😀 漢.") for _ in range(rnd.choice([1, 3, 60, 900]))) for _ in range(n)]
    rows = [(i, sents(n)) for i, n in enumerate([0, 1, 2, 0, 7, 300, 1, 0, 3])]
    df = spark.createDataFrame(rows, "i int, s array<string>").coalesce(1)
    got = df.select(adjacent_similarities("s").alias("a"), adjacent_similarities_in_batches(F.col("s")).alias("b")).collect()
    assert all(r.a == r.b for r in got) and [len(r.a) for r in got] == [0, 0, 1, 0, 6, 299, 0, 0, 2]


def test_tokens_are_collected_once(spark):
    docs = spark.createDataFrame([(1, "d", "Orre Orre ha, nd! 12 x")], "doc_id long, dataset_name string, text string")
    made = derived.tokens(docs)
    assert optimized(made).count("transform(") <= 4
    assert [(r.sent_id, r.tok_id, r.head, r.form, r.upos, r.ent_iob) for r in made.orderBy("tok_id").collect()] == [
        (0, 0, 0, "Orre", "X", "B"), (0, 1, 0, "Orre", "X", "I"), (0, 2, 0, "ha", "X", "B"), (0, 3, 0, ",", "PUNCT", "O"),
        (0, 4, 0, "nd", "X", "B"), (0, 5, 0, "!", "PUNCT", "O"), (1, 6, 6, "12", "NUM", "O"), (1, 7, 6, "x", "X", "O"),
    ]
