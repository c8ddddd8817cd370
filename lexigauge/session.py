"""Session defaults and the shared folder intermediate tables are kept in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's own setting: remove the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "lexigauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; anything given in `conf` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in `spark.checkpoint.dir`.

    Only a local session, where nothing is shared, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="lexigauge-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark).rstrip('/')}/lexigauge/{uuid.uuid4().hex}/{name}"


@contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each query within go with its end."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and go on from the written table.

    Cuts the lineage, survives the loss of executors, and gives later joins a known size. The shuffle
    files of the write go with its end, so a chain of written tables needs the disk of one step.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with without_shuffle_files(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if the table has at most `max_rows` rows; else leave it to Spark.

    Counts no further than the limit. Meant for written tables, where counting is cheap.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
