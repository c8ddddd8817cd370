from pyspark.sql import functions as F

from lexigauge.operators import clean as P
from lexigauge.operators import text_profile as T
from lexigauge.session import new_folder
from lexigauge.streaming import read_stream, write_available


def as_batch(spark, stream):
    out = new_folder(spark, "out")
    write_available(stream, out, new_folder(spark, "state"))
    return spark.read.schema(stream.schema).parquet(out)


def test_cleaning_on_a_stream(spark, sf_dir):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = read_stream(spark, sf_dir, batch.schema, "events.parquet")

    def cleaned(df):
        return P.clean_rows(df, "event_id", ["event_type", "props"])

    got = as_batch(spark, cleaned(stream))
    assert got.exceptAll(cleaned(batch)).count() == 0 and got.count() == batch.count()


def test_profile_on_a_stream(spark, sf_dir):
    batch = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stream = read_stream(spark, sf_dir, batch.schema, "documents.parquet")

    def profiled(df):
        return T.profile_documents(df, ["doc_id"], lang="lang").select(
            "doc_id", "n_words", "n_syllables", F.round("lix", 6).alias("lix")
        )

    got = as_batch(spark, profiled(stream))
    assert got.exceptAll(profiled(batch)).count() == 0 and got.count() == batch.count()
