import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigauge.operators import compare as C
from lexigauge.operators import moments as M
from lexigauge.plans import Comparison, group_report_lines, overall_report_lines

NAN = float("nan")
ROWS = [
    ("a", 1.0, 2.0, 7.0),
    ("a", 2.0, 1.0, 7.0),
    ("a", 4.0, 5.0, 7.0),
    ("a", 3.0, None, 7.0),
    ("b", 10.0, 1.0, 7.0),
    ("b", 12.0, 4.0, 7.0),
    ("b", 9.0, NAN, 7.0),
    ("line", 1.0, 1.0, 7.0),
    ("line", 2.0, 2.0, 7.0),
    ("line", 3.0, 3.0, 7.0),
    ("one", 5.0, 5.0, 7.0),
    (None, 6.0, 2.0, 7.0),
]
USERS = [("u", 2.0, 3.0, 7.0), ("u", 4.0, 1.0, 7.0), ("v", 9.0, 9.0, 8.0)]
PAIR = ["f1", "f2"]


@pytest.fixture
def master(spark):
    return spark.createDataFrame(ROWS, "grp string, f1 double, f2 double, f3 double")


@pytest.fixture
def user(spark):
    return spark.createDataFrame(USERS, "dataset_name string, f1 double, f2 double, f3 double")


def column(name):
    i = {"f1": 1, "f2": 2}[name]
    return np.array([NAN if r[i] is None else r[i] for r in ROWS])


def scaled(name, value):
    x = column(name)
    return (value - np.nanmean(x)) / np.nanstd(x)


def test_fit(master):
    fit = M.fit_scaler(master, ["f1", "f2", "f3"]).first()
    assert fit.mean == pytest.approx([np.nanmean(column("f1")), np.nanmean(column("f2")), 7.0])
    assert fit.scale == pytest.approx([np.nanstd(column("f1")), np.nanstd(column("f2")), 1.0])


def test_standardize(master):
    fit = M.fit_scaler(master, PAIR)
    z = M.standardize(master, PAIR, fit).agg(F.avg("f1"), F.stddev_pop("f1"), F.count("f2")).first()
    assert z[0] == pytest.approx(0, abs=1e-12) and z[1] == pytest.approx(1)
    assert z[2] == 10


def test_scaling_features_changes_nothing(master):
    bigger = master.withColumn("f1", F.col("f1") * 1000)
    a, b = (M.standardize(d, PAIR, M.fit_scaler(d, PAIR)).agg(F.max("f1")).first()[0] for d in (master, bigger))
    assert a == pytest.approx(b)


def test_scores(master, user):
    report = Comparison(master, user, PAIR).compare_to_groups("grp", "u")
    rows = {r.grp: r for r in report.scores.collect()}
    assert set(rows) == {"a", "b", "line", "one"}
    u = np.array([scaled("f1", 3.0), scaled("f2", 2.0)])
    # the group of one row and the group on a line have no usable inverse
    for name, point in (("one", (5.0, 5.0)), ("line", (2.0, 2.0))):
        straight = np.linalg.norm(u - [scaled("f1", point[0]), scaled("f2", point[1])])
        assert rows[name].method_used == "euclidean"
        assert rows[name].distance == pytest.approx(straight)
    a = np.array([r[1:3] for r in ROWS if r[0] == "a"], dtype=float)
    z = np.column_stack([scaled("f1", a[:, 0]), scaled("f2", a[:, 1])])
    full = z[~np.isnan(z).any(axis=1)]
    cov = np.array([[np.var(z[:, 0], ddof=1), 0], [0, np.nanvar(z[:, 1], ddof=1)]])
    cov[0, 1] = cov[1, 0] = np.cov(full.T)[0, 1]
    diff = u - np.nanmean(z, axis=0)
    assert rows["a"].method_used == "mahalanobis"
    assert rows["a"].distance == pytest.approx(math.sqrt(diff @ np.linalg.inv(cov) @ diff))
    assert rows["a"].similarity == pytest.approx(math.exp(-rows["a"].distance))
    assert [r.rank for r in sorted(rows.values(), key=lambda r: -r.similarity)] == [1, 2, 3, 4]
    assert all(0 < r.similarity <= 1 for r in rows.values())


def test_group_with_itself(master):
    itself = master.filter("grp = 'a'").withColumnRenamed("grp", "dataset_name")
    report = Comparison(master, itself, PAIR).compare_to_groups("grp", "a")
    assert report.scores.filter("grp = 'a'").first().distance == pytest.approx(0, abs=1e-9)


def test_differences(master, user):
    report = Comparison(master, user, ["f1", "f2", "f3"]).compare_to_groups("grp", "u", top_n_features=2)
    details = {(r.grp, r.feature): r for r in report.details.collect()}
    assert len(details) == 12
    row = details["b", "f1"]
    b = scaled("f1", np.array([10.0, 12.0, 9.0]))
    assert row.user_value == pytest.approx(scaled("f1", 3.0))
    assert row.z_score == pytest.approx((row.user_value - b.mean()) / (b.std(ddof=1) + 1e-10))
    assert row.contribution == pytest.approx(abs(row.z_score) * b.std(ddof=1))
    assert details["b", "f3"].contribution == 0.0
    assert details["one", "f1"].z_score is None
    top = report.key_differences.filter("grp = 'b'").orderBy("rank").collect()
    assert [r.feature for r in top] == ["f1", "f2"]


def test_user_vectors(master, user):
    fit = M.fit_scaler(master, PAIR)
    both = C.user_vector(user, PAIR, fit, "u").first()
    assert both.n_rows == 2
    assert both.std[0] == pytest.approx(np.std([2, 4], ddof=1) / np.nanstd(column("f1")))
    assert C.user_vector(user, PAIR, fit, "v").first().std == [0.0, 0.0]
    everyone = C.user_vector(user, PAIR, fit).first()
    assert everyone.mean[0] == pytest.approx(scaled("f1", 5.0)) and everyone.std == [0.0, 0.0]


def test_unknown_dataset(master, user):
    with pytest.raises(ValueError):
        Comparison(master, user, PAIR).compare_to_groups("grp", "nobody")
    with pytest.raises(ValueError):
        Comparison(master, user, PAIR).compare_to_groups("grp", "u", comparison_method="cosine")


def test_overall(master, user):
    report = Comparison(master, user, PAIR).general_comparison("u", top_n_features=1)
    rows = {r.feature: r for r in report.feature_comparison.collect()}
    x = column("f1")
    std = np.nanstd(x, ddof=1) / np.nanstd(x)
    assert rows["f1"].master_std == pytest.approx(std)
    assert rows["f1"].z_score == pytest.approx(scaled("f1", 3.0) / (std + 1e-10))
    assert rows["f1"].similarity == pytest.approx(1 / (1 + abs(rows["f1"].z_score)))
    assert report.most_divergent_features.count() == 1


def test_wide_comparison(spark):
    rng = np.random.default_rng(1)
    names = [f"f{i}" for i in range(10)]
    data = [("a" if i % 2 else "b", *map(float, rng.normal(size=10))) for i in range(200)]
    master = spark.createDataFrame(data, ["grp", *names])
    report = Comparison(master, master.withColumnRenamed("grp", "dataset_name"), names).compare_to_groups("grp", "a")
    best = report.scores.filter("rank = 1").first()
    assert best.grp == "a" and best.distance == pytest.approx(0, abs=1e-6)


def test_reports(master, user):
    comparison = Comparison(master, user, PAIR)
    lines = [r.text for r in group_report_lines(comparison.compare_to_groups("grp", "u")).orderBy("line_no").collect()]
    assert lines[0] == "Top Statistical Matches"
    assert lines[1].endswith("%") and len(lines) == 1 + 4 + 1 + 2
    assert lines[5].startswith("Key Differences vs ")
    overall = comparison.general_comparison("u")
    lines = [r.text for r in overall_report_lines(overall).orderBy("line_no").collect()]
    assert lines[0] == "Overall Statistical Comparison"
    assert lines[1] == "Master Data Means: f1=0.00, f2=0.00"
    assert lines[3] == "Most Divergent Features" and len(lines) == 6


def test_master_is_read_once(master, user):
    summary = M.group_summary(master, "grp", PAIR)
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
