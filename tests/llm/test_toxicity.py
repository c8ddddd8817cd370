import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from lexigauge.llm import toxicity


def test_held_out_rule(spark):
    got = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_features_are_distinct_ngrams():
    seen = np.zeros(toxicity.BUCKETS, bool)
    grams = {t[i : i + n] for t in [" aaaé aaaé "] for n in (3, 4, 5) for i in range(len(t) - n + 1)}
    assert len(toxicity.features("AAAÉ aaaé", seen)) == len(grams) and not seen.any()
    assert len(toxicity.features("", seen)) == 0


def test_learns_and_holds_out(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(80)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 60))] + ["grobian"] * toxic
        rnd.shuffle(text)
        rows.append((i, " ".join(text), "x"))
        # labels of held-out rows lie, and must not be learned
        labels.append((i, int(toxic) if zlib.crc32(str(i).encode()) % 5 else int(not toxic), 1.0))
    rows += [(900, None, None), (901, "", None), (None, "grobian" * 2000, None), (3, rows[3][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1, 1.0), (5000, None, 1.0)], "doc_id long, toxic int, text double"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    right = [r.predicted == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 400]
    assert np.mean(right) > 0.95


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0.5]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_accuracy_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs.join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).select("doc_id", "text", "toxic"), model)
    assert out.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0] > 0.93  # a part of the toxic rows of this table holds no toxic word
