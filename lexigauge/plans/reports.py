"""Comparison reports as tables `(line_no, text)`; printing is left to the caller.

A line's number follows from its section and its rank there, so no report is ordered as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigauge.fixed_values import (
    DIFFERENCE_LINE,
    DIFFERENCES_HEADING,
    DIVERGENT_HEADING,
    DIVERGENT_LINE,
    GROUP_HEADING,
    GROUP_LINE,
    MASTER_MEANS,
    MEAN_ENTRY,
    OVERALL_HEADING,
    USER_MEANS,
)
from lexigauge.plans.comparison import GroupReport, OverallReport


def _lines(df: DataFrame, number: Column, text: Column) -> DataFrame:
    return df.select(number.cast("int").alias("line_no"), text.alias("text"))


def group_report_lines(report: GroupReport) -> DataFrame:
    """Groups by similarity in percent, then the key differences from the nearest group."""
    top = report.scores.filter(F.col("rank") == 1)
    nearest = report.key_differences.join(top.select("grp"), "grp")
    n_groups = report.scores.agg(F.count("*")).scalar()
    shown = F.format_string(GROUP_LINE, F.col("grp"), F.col("similarity") * 100)
    difference = F.format_string(DIFFERENCE_LINE, "feature", "user_value", "group_mean", "z_score")
    parts = [
        _lines(top, F.lit(1), F.lit(GROUP_HEADING)),
        _lines(report.scores, F.col("rank") + 1, shown),
        _lines(top, n_groups + 2, F.concat(F.lit(DIFFERENCES_HEADING), F.col("grp"))),
        _lines(nearest, n_groups + 2 + F.col("rank"), difference),
    ]
    return reduce(DataFrame.unionByName, parts)


def _means(stats: DataFrame, column: str, title: str) -> DataFrame:
    in_order = F.array_sort(F.collect_list(F.struct("pos", "feature", F.col(column).alias("v"))))
    shown = F.transform(in_order, lambda e: F.format_string(MEAN_ENTRY, e["feature"], e["v"]))
    return stats.agg(F.concat(F.lit(title), F.array_join(shown, ", ")).alias("line"))


def overall_report_lines(report: OverallReport) -> DataFrame:
    """Means of the reference and of the dataset, then the most divergent features."""
    first = report.overall_stats.filter(F.col("pos") == 0)
    features = report.most_divergent_features
    size = F.abs("z_score")
    entry = F.struct(size.isNull().alias("none"), (-size).alias("key"), "pos", F.struct(*features.columns).alias("f"))
    # as many as were asked for
    divergent = features.agg(F.array_sort(F.collect_list(entry)).alias("all")).select(F.posexplode("all").alias("at", "e"))
    divergent = divergent.select("at", "e.f.*")
    line = F.format_string(
        DIVERGENT_LINE,
        F.col("feature"),
        F.col("user_value"),
        F.col("master_mean"),
        F.col("master_std"),
        F.col("z_score"),
        F.col("similarity") * 100,
    )
    parts = [
        _lines(first, F.lit(1), F.lit(OVERALL_HEADING)),
        _lines(_means(report.overall_stats, "master_mean", MASTER_MEANS), F.lit(2), F.col("line")),
        _lines(_means(report.overall_stats, "user_value", USER_MEANS), F.lit(3), F.col("line")),
        _lines(first, F.lit(4), F.lit(DIVERGENT_HEADING)),
        _lines(divergent, F.col("at") + 5, line),
    ]
    return reduce(DataFrame.unionByName, parts)
