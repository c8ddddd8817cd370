"""Quoted CSV tables, the guard of normalised tables, and covariances without full rank."""

import numpy as np
import pytest
from pyspark.sql import types as T

from lexigauge.operators.compare import mahalanobis
from lexigauge.sources.tables import read_table, write_normalized


def test_quoted_csv(spark, tmp_path):
    path = tmp_path / "user.csv"
    path.write_text('dataset_name,f\n"say ""hi"", ok",1.5\n"two\nlines",2.5\n')
    schema = T.StructType([T.StructField("dataset_name", T.StringType()), T.StructField("f", T.DoubleType())])
    for given in (None, schema):
        rows = sorted(tuple(r) for r in read_table(spark, str(path), given).collect())
        assert rows == [('say "hi", ok', 1.5), ("two\nlines", 2.5)]


def test_normalised_never_over_its_source(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "dataset_name string, f double")
    source = str(tmp_path / "features")
    df.write.parquet(source)
    for same in (source, source + "/", f"file:{source}", f"{tmp_path}/./features"):
        with pytest.raises(ValueError):
            write_normalized(df, same, source)
    write_normalized(df, source + "_norm", source)


def test_no_distance_without_full_rank(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(200):
        x = rng.normal(size=(6 if i % 2 else 40, 12))
        rows.append((i, rng.normal(size=12).tolist(), np.cov(x.T, bias=True).tolist()))
    df = spark.createDataFrame(rows, "i int, diff array<double>, cov array<array<double>>")
    for r in df.select("i", mahalanobis("diff", "cov").alias("d")).collect():
        assert (r.d is None) == (r.i % 2 == 1)
