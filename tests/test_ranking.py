"""Ranks and report lines without a task that holds every group."""

import random

import pytest
from pyspark.sql import functions as F

from lexigauge.operators import compare as C
from lexigauge.operators.ranking import ranked
from lexigauge.plans import group_report_lines, overall_report_lines
from lexigauge.plans.comparison import Comparison, GroupReport
from tests.conftest import physical


@pytest.mark.parametrize("n,parts", [(0, 3), (1, 1), (5, 4), (3000, 7)])
def test_ranks(spark, n, parts):
    rnd = random.Random(n)
    rows = [(f"g{i:05d}", rnd.choice([None, 0.0, 1.5, float(i % 40)])) for i in range(n)]
    df = spark.createDataFrame(rows, "grp string, distance double").repartition(parts)
    got = sorted((r["rank"], r.grp) for r in C.ranked_groups(df).collect())
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0.0, r[0]))
    assert got == [(i + 1, r[0]) for i, r in enumerate(want)]


def test_many_partitions(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(5000).withColumn("x", F.xxhash64("id"))
        out = ranked(df, [F.col("x")])
        assert out.select(F.spark_partition_id()).distinct().count() > 1
        wrong = out.orderBy("x").select("rank").collect()
        assert [r[0] for r in wrong] == list(range(1, 5001))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_a_million_groups(spark):
    groups = spark.range(1_000_000).select(F.concat(F.lit("g"), "id").alias("grp"), (F.xxhash64("id") % 1000 / 1000.0).alias("distance"))
    out = C.ranked_groups(groups)
    found = out.agg(F.count("*"), F.count_distinct("rank"), F.min("rank"), F.max("rank")).first()
    assert tuple(found) == (1_000_000, 1_000_000, 1, 1_000_000)


def test_no_window_over_all_groups(spark):
    rows = [(f"g{i % 5}", float(i), float(i * i % 17)) for i in range(60)]
    df = spark.createDataFrame(rows, "grp string, f1 double, f2 double")
    comparison = Comparison(df, df.withColumnRenamed("grp", "dataset_name"), ["f1", "f2"])
    report = comparison.compare_to_groups("grp", "g1")
    for plan in (physical(report.scores), physical(group_report_lines(report)), physical(overall_report_lines(comparison.general_comparison("g1")))):
        for window in [line for line in plan.splitlines() if "Window " in line]:
            assert "windowspecdefinition(grp" in window
    assert [r.line_no for r in group_report_lines(report).orderBy("line_no").collect()] == list(range(1, 10))


def test_report_without_groups(spark):
    scores = spark.createDataFrame([], "grp string, distance double, similarity double, rank int")
    differences = spark.createDataFrame([], "grp string, feature string, user_value double, group_mean double, z_score double, rank int")
    assert group_report_lines(GroupReport(scores, differences, differences)).collect() == []
