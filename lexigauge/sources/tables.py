"""Reading and writing of tables of texts, features and normalised features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigauge.fixed_values import UNNAMED
from lexigauge.sources.csv_text import read_csv_by_name


def _is_csv(path: str) -> bool:
    return path.rstrip("/").endswith(".csv")


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True
) -> DataFrame:
    """A Parquet table, or a CSV table with a header if the path says so.

    Cells may be quoted, hold doubled quotes and line breaks. Without a schema a CSV is read twice.
    `multi_line=False` lets Spark split large files; use it where no cell holds a line break.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    if _is_csv(path):
        if schema is None:
            reader = reader.option("inferSchema", True)
        return reader.csv(path, header=True, quote='"', escape='"', multiLine=multi_line)
    return reader.parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a table that has fewer input splits than cores, as small files do.

    Tables with enough splits pass unchanged, so large inputs are never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _named(df: DataFrame) -> DataFrame:
    """`dataset_name` first; a placeholder where the table has none."""
    name = F.col("dataset_name") if "dataset_name" in df.columns else F.lit(UNNAMED)
    return df.select(
        name.alias("dataset_name"), *[F.col(f"`{c}`") for c in df.columns if c != "dataset_name"]
    )


def union_features(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both tables over the union of their columns; nothing is deduplicated."""
    return _named(existing).unionByName(_named(new), allowMissingColumns=True)


def append_features(df: DataFrame, path: str) -> None:
    """Add feature rows to a stored table, CSV with headers if the path says so. Old rows are not rewritten."""
    writer = _named(df).write.mode("append")
    if _is_csv(path):
        writer.options(header=True, escape='"').csv(path)
    else:
        writer.parquet(path)


def read_features(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Stored feature rows; without a schema, over the union of all stored columns.

    Columns of a CSV table are found by the header of each of its files; without a schema all but
    `dataset_name` are numbers, and what is none is null.
    """
    if _is_csv(path):
        stored = read_csv_by_name(spark, path)
        found = list(dict.fromkeys(stored.headers))
        kinds = {f.name: f.dataType for f in schema} if schema else {c: T.StringType() if c == "dataset_name" else T.DoubleType() for c in found}
        cells = [(F.col(stored.column_of(c)) if c in found else F.lit(None)).try_cast(t).alias(c) for c, t in kinds.items()]
        return _named(stored.rows.select(*cells))
    if schema is None:
        return _named(spark.read.option("mergeSchema", True).parquet(path))
    return _named(spark.read.schema(schema).parquet(path))


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and folder, however it is written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return hadoop.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()


def write_normalized(df: DataFrame, path: str, source: str) -> None:
    """Write a normalised table beside its source, never over it."""
    if _qualified(df.sparkSession, path) == _qualified(df.sparkSession, source):
        raise ValueError("the normalised table must not replace its source")
    df.write.mode("overwrite").parquet(path)
