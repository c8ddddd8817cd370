"""Columns of the user's that have the names operators use inside."""

import corpus_pipeline
import pytest
from lexigauge.llm import licenses, line_dedup, sharding, simhash, suffix_dedup
from pyspark.sql import functions as F

NAMES = (
    "_block", "_n", "root", "component_id", "doc", "tie", "_id", "_gone", "_split", "_words", "_found", "_key", "_doc", "_tie",
    "_simhash", "simhash", "row", "place", "key", "block", "bucket", "at", "record", "first", "number", "_first", "_number", "words", "line_no", "fp", "fingerprint",
)
ROWS = [(1, "one two three four five six seven\nmit license text here and more"), (2, "one two three four five six seven\nother words"), (3, None), (4, "")]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    return frame.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in NAMES})


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


OPERATORS = {
    "op2": lambda spark, d, sf: line_dedup.drop_repeated_lines(d),
    "op4": lambda spark, d, sf: licenses.scan(d),
    "op5": lambda spark, d, sf: sharding.shuffled_shards(d, 3),
    "op9": lambda spark, d, sf: simhash.keep_one(d),
    "op10": lambda spark, d, sf: suffix_dedup.drop_repeats(d),
    "toxicity": lambda spark, d, sf: stage("toxicity")(spark, d, sf),
    "line dedup": lambda spark, d, sf: stage("line dedup")(spark, d.withColumns({"n_chars": F.lit(1), "lang": F.lit("en"), "source": F.lit("s")}), sf),
    "near-dedup": lambda spark, d, sf: stage("SimHash near-dedup")(spark, d, sf),
    "decontamination": lambda spark, d, sf: stage("benchmark decontamination")(spark, d, sf),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_values_stay(spark, docs, sf_dir, name):
    rows = OPERATORS[name](spark, docs, sf_dir).collect()
    assert rows
    for r in rows:
        assert [r[c] for c in NAMES] == [f"{c} of {r.doc_id}" for c in NAMES]


def test_written_shards(spark, docs, tmp_path):
    rows = sharding.write_shards(docs, str(tmp_path / "shards"), 3).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4]
    for r in rows:
        assert [r[c] for c in NAMES] == [f"{c} of {r.doc_id}" for c in NAMES]


def test_batch_size_stays(spark, docs):
    simhash.keep_one(docs).collect()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert int(before) <= 256
