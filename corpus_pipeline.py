"""A training corpus from `documents` in five stages, each written as Parquet and read by the next.

A stage is (name, function); the function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigauge.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from lexigauge.llm.common import free_name
from lexigauge.session import broadcast_within, materialize

#: Contaminated keys (longs) that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a classifier learned from `labels` takes for toxic (a score of 0.5 or more)."""
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that match a line before them; every document stays, with what is left of its text."""
    out = line_dedup.drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id.

    Near are SimHashes of 4-word shingles within 4 bits, as in op9: texts that are all but equal. Of pairs of
    different texts at Jaccard 0.8 or more most are farther apart (README gives the recall).
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that contain an item of `benchmark`. Rows are told apart by id and text."""
    key = free_name(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate.contained_items(keyed.select(key, "text"), items, doc_id=key)
    bad = materialize(found.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return keyed.join(broadcast_within(bad, BROADCAST_KEYS), key, "left_anti").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids of each text, and digests of the ids and of the text they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    done = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path)
    return done.select("doc_id", "lang", "source", "ids", *bpe.digests(done))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", tokenize),
]

#: A learned score and merges of bytes have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
