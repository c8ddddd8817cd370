"""Comparison of a dataset with reference groups, and with the reference as a whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigauge.operators import compare as C
from lexigauge.operators import compare_all as A
from lexigauge.operators import moments as M
from lexigauge.operators.wide_moments import wide_group_summary
from lexigauge.session import materialize


@dataclass(frozen=True)
class GroupReport:
    """`scores(grp, distance, method_used, similarity, rank)`, `details` and `key_differences`."""

    scores: DataFrame
    details: DataFrame
    key_differences: DataFrame


@dataclass(frozen=True)
class OverallReport:
    """`overall_stats`, `feature_comparison` and `most_divergent_features`, one row per feature."""

    overall_stats: DataFrame
    feature_comparison: DataFrame
    most_divergent_features: DataFrame


@dataclass(frozen=True)
class AllReport:
    """`scores(dataset_name, grp, distance, method_used, similarity, rank)` and `key_differences` of the kept pairs."""

    scores: DataFrame
    key_differences: DataFrame


def summary_of(master: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Moments of all groups and of the whole master table, from one scan of it."""
    wide = len(features) > M.MAX_BUILTIN_FEATURES
    return (wide_group_summary if wide else M.group_summary)(master, group, features)


def fitted_groups(master: DataFrame, group: str, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """The scaler fit and the standardised moments of every group, both out of one summary."""
    summary = summary_of(master, group, features)
    fit = summary.filter("is_total").select("n_rows", "mean", "std", "scale")
    return fit, M.scaled_groups(summary, fit)


class Comparison:
    """Compares datasets in `user` with the groups of `master`.

    The moments of the master table are computed once per group column and kept as a written
    table; every comparison after that reads the user table and a few rows per group.
    """

    def __init__(self, master: DataFrame, user: DataFrame, features: list[str]) -> None:
        self.master, self.user, self.features = master, user, list(features)
        self._fit: DataFrame | None = None
        self._groups: dict[str, DataFrame] = {}

    def fit(self) -> DataFrame:
        if self._fit is None:
            self._fit = materialize(M.fit_scaler(self.master, self.features), "fit")
        return self._fit

    def groups(self, group_column: str) -> DataFrame:
        """Standardised moments per group; rows with a null group are kept apart as group null."""
        if group_column not in self._groups:
            summary = materialize(summary_of(self.master, group_column, self.features), "summary")
            if self._fit is None:
                self._fit = summary.filter("is_total").select("n_rows", "mean", "std", "scale")
            moments = M.scaled_groups(summary, self._fit)
            self._groups[group_column] = moments
        return self._groups[group_column]

    def _vector(self, dataset_name: str | None, name_column: str) -> DataFrame:
        vector = materialize(
            C.user_vector(self.user, self.features, self.fit(), dataset_name, name_column), "vector"
        )
        if dataset_name is not None and vector.filter(F.col("n_rows") > 0).isEmpty():
            raise ValueError(f"dataset {dataset_name!r} not found in column {name_column!r}")
        return vector

    def compare_to_groups(
        self,
        group_column: str,
        dataset_name: str | None = None,
        name_column: str = "dataset_name",
        comparison_method: str = "mahalanobis",
        top_n_features: int = 3,
    ) -> GroupReport:
        groups = self.groups(group_column)
        vector = self._vector(dataset_name, name_column)
        distances = C.group_distances(groups, vector, comparison_method)
        details = C.feature_differences(groups, vector, self.features)
        return GroupReport(
            C.ranked_groups(distances), details, C.key_differences(details, top_n_features)
        )

    def compare_all_to_groups(
        self,
        group_column: str,
        name_column: str = "dataset_name",
        comparison_method: str = "mahalanobis",
        top_n_groups: int = 3,
        top_n_features: int = 3,
    ) -> AllReport:
        """Every dataset of the user table with its best groups, in one job; null groups and names are left out."""
        groups = self.groups(group_column)
        datasets = materialize(A.dataset_vectors(self.user, self.features, self.fit(), name_column), "datasets")
        best = A.best_groups(groups, datasets, len(self.features), top_n_groups, comparison_method)
        best = materialize(best, "best_groups")
        return AllReport(best, A.top_differences(best, groups, datasets, self.features, top_n_features))

    def general_comparison(
        self,
        dataset_name: str | None = None,
        name_column: str = "dataset_name",
        top_n_features: int = 5,
    ) -> OverallReport:
        stats = C.overall_stats(self.fit(), self._vector(dataset_name, name_column), self.features)
        compared = C.feature_comparison(stats)
        return OverallReport(stats, compared, C.divergent_features(compared, top_n_features))
