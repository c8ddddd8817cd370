"""Distances, scores and feature differences between a dataset and reference groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigauge.fixed_values import STD_GUARD
from lexigauge.operators.moments import feature_columns
from lexigauge.operators.ranking import ranked


def select_dataset(user: DataFrame, dataset_name: str | None, name_column: str) -> DataFrame:
    """Rows of one dataset; all rows if no name is given."""
    return user if dataset_name is None else user.filter(F.col(f"`{name_column}`") == dataset_name)


def user_vector(
    user: DataFrame,
    features: list[str],
    fit: DataFrame,
    dataset_name: str | None = None,
    name_column: str = "dataset_name",
) -> DataFrame:
    """One row `(n_rows, mean, std)` of standardised features.

    Without a name the rows are averaged first, which leaves one row; the deviation of a
    single row is 0. Scaling is applied to the moments, which is the same by linearity.
    """
    names = [f"f{i}" for i in range(len(features))]
    rows = select_dataset(user, dataset_name, name_column).select(*feature_columns(features))
    raw = rows.agg(
        F.count("*").alias("n_rows"),
        F.array(*[F.avg(c) for c in names]).alias("mean"),
        F.array(*[F.stddev_samp(c) for c in names]).alias("std"),
    ).withColumn("_fit", fit.select(F.struct("mean", "scale")).scalar())
    centred = F.zip_with(F.col("mean"), F.col("_fit.mean"), lambda x, m: x - m)
    spread = F.zip_with(F.col("std"), F.col("_fit.scale"), lambda x, s: x / s)
    single = F.lit(True) if dataset_name is None else F.col("n_rows") <= 1
    return raw.select(
        "n_rows",
        F.zip_with(centred, F.col("_fit.scale"), lambda x, s: x / s).alias("mean"),
        F.when(single, F.transform("mean", lambda _: F.lit(0.0))).otherwise(spread).alias("std"),
    )


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


@F.pandas_udf(T.DoubleType())
def mahalanobis(diff: pd.Series, cov: pd.Series) -> pd.Series:
    """Distance by the inverse covariance; null where it lacks full rank or is not finite."""

    def one(d, c):
        if d is None or c is None:
            return None
        vector = np.array(d, dtype="float64")
        matrix = np.array([np.asarray(row, dtype="float64") for row in c])
        if not (np.isfinite(vector).all() and np.isfinite(matrix).all()):
            return None
        # a matrix without full rank often has an inverse, but one of rounding errors
        if np.linalg.matrix_rank(matrix, hermitian=True) < len(matrix):
            return None
        square = vector @ np.linalg.inv(matrix) @ vector
        return float(np.sqrt(square)) if np.isfinite(square) and square >= 0 else None

    return pd.Series([one(d, c) for d, c in zip(diff, cov)], dtype="float64")


def group_distances(groups: DataFrame, user: DataFrame, method: str = "mahalanobis") -> DataFrame:
    """`(grp, distance, method_used)`; the Euclidean distance where Mahalanobis is undefined."""
    if method not in ("mahalanobis", "euclidean"):
        raise ValueError("method must be 'mahalanobis' or 'euclidean'")
    paired = groups.filter(F.col("grp").isNotNull()).withColumn("_user", user.select("mean").scalar())
    straight = euclidean(F.col("_user"), F.col("mean"))
    if method == "euclidean":
        return paired.select("grp", straight.alias("distance"), F.lit("euclidean").alias("method_used"))
    diff = F.zip_with(F.col("_user"), F.col("mean"), lambda u, m: u - m)
    measured = paired.select(
        "grp", straight.alias("straight"), mahalanobis(diff, F.col("cov")).alias("skewed")
    )
    usable = F.col("skewed").isNotNull() & ~F.isnan("skewed")
    return measured.select(
        "grp",
        F.when(usable, F.col("skewed")).otherwise(F.col("straight")).alias("distance"),
        F.when(usable, F.lit("mahalanobis")).otherwise(F.lit("euclidean")).alias("method_used"),
    )


def ranked_groups(distances: DataFrame) -> DataFrame:
    """Adds similarity = exp(-distance) and the rank by it, ties by group name. Written by ranges, in no single task."""
    scored = distances.withColumn("similarity", F.exp(-F.col("distance")))
    return ranked(scored, [F.col("similarity").desc_nulls_last(), F.col("grp").asc()])


def _labelled(features: list[str]) -> Column:
    return F.array(*[F.lit(f) for f in features])


def feature_differences(groups: DataFrame, user: DataFrame, features: list[str]) -> DataFrame:
    """`(grp, pos, feature, user_value, group_mean, z_score, contribution)`, all features."""
    paired = groups.filter(F.col("grp").isNotNull()).withColumn("_user", user.select("mean").scalar())
    long = paired.select(
        "grp",
        F.posexplode(
            F.arrays_zip(
                _labelled(features).alias("feature"),
                F.col("_user").alias("user_value"),
                F.col("mean").alias("group_mean"),
                F.col("std").alias("group_std"),
            )
        ).alias("pos", "e"),
    ).select("grp", "pos", "e.*")
    z_score = (F.col("user_value") - F.col("group_mean")) / (F.col("group_std") + F.lit(STD_GUARD))
    return long.withColumn("z_score", z_score).select(
        "grp",
        "pos",
        "feature",
        "user_value",
        "group_mean",
        "z_score",
        (F.abs("z_score") * F.col("group_std")).alias("contribution"),
    )


def key_differences(differences: DataFrame, top_n: int = 3) -> DataFrame:
    """The `top_n` features of every group by contribution, ties in feature order."""
    order = Window.partitionBy("grp").orderBy(F.col("contribution").desc_nulls_last(), "pos")
    return differences.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)


def overall_stats(fit: DataFrame, user: DataFrame, features: list[str]) -> DataFrame:
    """`(pos, feature, master_mean, master_std, user_value, user_std)` of standardised data."""
    both = fit.select("mean", "std", "scale").withColumn("_user", user.select(F.struct("mean", "std")).scalar())
    # The standardised mean is (mean - mean) / scale: 0 for every feature with a value.
    return both.select(
        F.posexplode(
            F.arrays_zip(
                _labelled(features).alias("feature"),
                F.transform("mean", lambda m: m - m).alias("master_mean"),
                F.zip_with("std", "scale", lambda s, k: s / k).alias("master_std"),
                F.col("_user.mean").alias("user_value"),
                F.col("_user.std").alias("user_std"),
            )
        ).alias("pos", "e")
    ).select("pos", "e.*")


def feature_comparison(stats: DataFrame) -> DataFrame:
    """Adds z_score and similarity = 1 / (1 + |z|)."""
    z_score = (F.col("user_value") - F.col("master_mean")) / (F.col("master_std") + F.lit(STD_GUARD))
    return stats.withColumn("z_score", z_score).withColumn(
        "similarity", 1 / (1 + F.abs(F.col("z_score")))
    )


def divergent_features(comparison: DataFrame, top_n: int = 5) -> DataFrame:
    """The `top_n` features by |z|, ties in feature order."""
    return comparison.orderBy(F.abs("z_score").desc_nulls_last(), "pos").limit(top_n)
