"""Means, deviations and covariances of feature tables, overall and per group.

NaN features count as missing. Everything after the moments works on one row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BUILTIN_FEATURES = 8  # above this, moments come from `wide_moments`


def _numeric(feature: str) -> str:
    """SQL for a feature as DOUBLE, NaN turned into NULL."""
    quoted = feature.replace("`", "``")
    return f"nanvl(cast(`{quoted}` as double), cast(null as double))"


def feature_columns(features: list[str]) -> list[Column]:
    """The features as `f0`, `f1` ..., missing where they are NaN."""
    return [F.expr(f"{_numeric(f)} as f{i}") for i, f in enumerate(features)]


def _names(features: list[str]) -> list[str]:
    return [f"f{i}" for i in range(len(features))]


def scale_of(std_pop: Column, low: Column, high: Column) -> Column:
    """Population deviation, or 1 for a constant feature."""
    return F.when((high > low) & (std_pop > 0), std_pop).otherwise(
        F.when(low.isNotNull(), F.lit(1.0))
    )


def _array(columns: list[Column]) -> Column:
    return F.array(*columns)


def _builtin_moments(names: list[str]) -> list[Column]:
    return [
        F.count("*").alias("n_rows"),
        _array([F.avg(c) for c in names]).alias("mean"),
        _array([F.stddev_samp(c) for c in names]).alias("std"),
        _array([scale_of(F.stddev_pop(c), F.min(c), F.max(c)) for c in names]).alias("scale"),
    ]


def fit_scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """One row `(n_rows, mean, std, scale)` of arrays in feature order.

    Wide tables are unpivoted, which keeps the aggregation at four expressions per row
    whatever the number of features.
    """
    names = _names(features)
    table = df.select(*feature_columns(features))
    if len(features) <= MAX_BUILTIN_FEATURES:
        return table.agg(*_builtin_moments(names))
    long = table.select(F.posexplode(F.array(*names)).alias("pos", "x"))
    per_feature = long.groupBy("pos").agg(
        F.count("*").alias("n_rows"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        scale_of(F.stddev_pop("x"), F.min("x"), F.max("x")).alias("scale"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean", "std", "scale")))
    packed = per_feature.agg(F.max("n_rows").alias("n_rows"), ordered.alias("by_pos"))
    return packed.select(
        "n_rows",
        *[F.col("by_pos")[k].alias(k) for k in ("mean", "std", "scale")],
    )


def standardize(df: DataFrame, features: list[str], fit: DataFrame) -> DataFrame:
    """Replace the features by (x - mean) / scale; the one-row fit enters as a scalar subquery."""
    known = df.withColumn("_fit", fit.select(F.struct("mean", "scale")).scalar())
    scaled = {
        f: F.expr(f"({_numeric(f)} - _fit.mean[{i}]) / _fit.scale[{i}]")
        for i, f in enumerate(features)
    }
    return known.withColumns(scaled).drop("_fit")


def group_summary(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Moments of every group and of the whole table, in one scan.

    `(is_total, grp, n_rows, mean, std, scale, cov)`; the grand total comes from the same
    rollup as the groups, so rows are read once.
    """
    names = _names(features)
    table = df.select(F.col(f"`{group}`").cast("string").alias("grp"), *feature_columns(features))
    p = range(len(names))
    cov = {(i, j): F.covar_samp(names[i], names[j]) for i in p for j in p if i <= j}
    matrix = F.array(*[F.array(*[cov[min(i, j), max(i, j)] for j in p]) for i in p])
    return table.rollup("grp").agg(
        (F.grouping_id() == 1).alias("is_total"), *_builtin_moments(names), matrix.alias("cov")
    )


def scaled_groups(summary: DataFrame, fit: DataFrame) -> DataFrame:
    """Group moments as if the rows had been standardised first: the scaling is affine."""
    known = fit.select(F.struct("mean", "scale")).scalar()
    groups = summary.filter(~F.col("is_total")).withColumn("_fit", known)
    centred = F.zip_with(F.col("mean"), F.col("_fit.mean"), lambda x, m: x - m)
    return groups.select(
        "grp",
        "n_rows",
        F.zip_with(centred, F.col("_fit.scale"), lambda x, s: x / s).alias("mean"),
        F.zip_with(F.col("std"), F.col("_fit.scale"), lambda x, s: x / s).alias("std"),
        F.zip_with(
            F.col("cov"),
            F.col("_fit.scale"),
            lambda row, si: F.zip_with(row, F.col("_fit.scale"), lambda c, sj: c / (si * sj)),
        ).alias("cov"),
    )
