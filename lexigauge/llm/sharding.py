"""Shuffled shards by a two-pass external shuffle.

Pass 1 scatters rows uniformly, by a seeded hash of the whole row, into buckets that fit in memory.
Pass 2 puts each bucket in random order (Spark's `shuffle` of an array is a Fisher-Yates shuffle)
and writes it. The buckets one after the other are the shuffled table; its row p goes to shard
p mod n, place p div n. So shards differ by one row at most and have no gaps.

Rows that are equal in every column share a bucket: which of them is which can't be told. Nulls are
values like others. An empty table gives an empty result. Columns named `shard` or `slot` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_within, materialize, without_shuffle_files
from .common import free_name

BUCKET_BYTES = 16 << 20
SEED = 20_240
#: Buckets whose offsets are added up together.
SPAN = 1024
#: Buckets up to which their offsets are broadcast, so that the rows aren't shuffled to meet them.
BROADCAST_BUCKETS = 1_000_000


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes in memory."""
    varied = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)
    sizes = [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) + 24 for f in df.schema.fields if isinstance(f.dataType, varied)]
    return sum(sizes, F.lit(16 * len(df.columns) + 32)).cast("long")


def shuffled_shards(df: DataFrame, n_shards: int = 16, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of `df` with `shard` (0 to n_shards - 1) and `slot`, their place in it from 0.

    The shuffled buckets are written to the shared folder, so a lost executor can't change the order.
    """
    rows = df.drop("shard", "slot")
    total = rows.select(row_bytes(rows).alias("b")).agg(F.sum("b")).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_bytes))
    names = rows.columns
    whole = F.struct(*[F.col(c) for c in names])
    key = F.xxhash64(F.lit(seed), *[F.col(c) for c in names])
    scattered = rows.select(F.pmod(key, F.lit(n_buckets)).alias("bucket"), F.struct(key.alias("key"), whole.alias("row")).alias("record"))
    # sorted first, so that a bucket's order depends on its rows and the seed, not on who came first
    gathered = scattered.groupBy("bucket").agg(F.array_sort(F.collect_list("record"), _by_key).alias("records"))
    mixed = gathered.sortWithinPartitions("bucket").select("bucket", F.shuffle("records", seed).alias("records"))
    written = materialize(mixed.select("bucket", F.posexplode("records").alias("at", "record")).select("bucket", "at", F.col("record.row").alias("row")), "buckets")
    counts = written.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("bucket") / SPAN))
    # running sums in two steps: within spans of buckets, and over one row for each span
    within = counts.withColumn("before", F.sum("n").over(Window.partitionBy("span").orderBy("bucket")) - F.col("n"))
    spans = counts.groupBy("span").agg(F.sum("n").alias("n_span"))
    spans = spans.select("span", (F.sum("n_span").over(Window.orderBy("span")) - F.col("n_span")).alias("earlier"))
    offsets = materialize(within.join(spans, "span").select("bucket", (F.col("before") + F.col("earlier")).alias("offset")), "offsets")
    place = F.col("at") + F.col("offset")
    return written.join(broadcast_within(offsets, BROADCAST_BUCKETS), "bucket").select(
        "row.*", F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"), F.floor(place / n_shards).cast("long").alias("slot")
    )


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)


def write_shards(df: DataFrame, path: str, n_shards: int = 16, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the shards as Parquet in folders shard=0, shard=1, ..., each file in the order of `slot`.

    Returns the rows as they are read back, with `shard` and `slot`.
    """
    placed = shuffled_shards(df, n_shards, seed, bucket_bytes)
    block = free_name(placed, "block")
    blocks = placed.withColumn(block, F.floor(F.col("slot") / (1 << 17)))
    with without_shuffle_files(df.sparkSession):
        blocks.repartition("shard", block).sortWithinPartitions("shard", "slot").drop(block).write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path).select(*placed.columns)
