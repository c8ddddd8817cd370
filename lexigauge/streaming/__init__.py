"""The row-wise operators on a stream: they are stateless, so no watermark is involved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet") -> DataFrame:
    """A stream over the Parquet files of a folder, including those yet to come."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything there is now, exactly once across restarts, and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
