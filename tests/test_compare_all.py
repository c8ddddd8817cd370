"""All datasets at once against one comparison each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigauge.operators import compare_all as A
from lexigauge.plans import Comparison
from tests.conftest import optimized, physical

P = 5
NAMES = [f"f{i}" for i in range(P)]
SCHEMA = ", ".join(f"{n} double" for n in NAMES)


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(0)
    rows = [(f"g{i % 6}", *map(float, rng.normal(size=P) + i % 6)) for i in range(300)]
    rows += [("single", *map(float, range(P))), ("flat", *[1.0] * P), ("flat", *[2.0] * P), (None, *[9.0] * P)]
    rows += [("gaps", *(None if rng.random() < 0.3 else float(v) for v in rng.normal(size=P))) for _ in range(40)]
    users = [(f"d{i % 40}", *map(float, rng.normal(size=P) * 3)) for i in range(200)]
    users += [("d gap", 1.0, None, 2.0, 3.0, 4.0), ("far", *[1e6] * P), (None, *[0.0] * P)]
    return spark.createDataFrame(rows, f"grp string, {SCHEMA}").repartition(3), spark.createDataFrame(users, f"dataset_name string, {SCHEMA}").repartition(4)


@pytest.mark.parametrize("method", ["mahalanobis", "euclidean"])
@pytest.mark.parametrize("block", [8 << 20, 600])
def test_as_one_by_one(tables, monkeypatch, method, block):
    comparison = Comparison(*tables, NAMES)
    report = comparison.compare_all_to_groups("grp", comparison_method=method, top_n_groups=4, top_n_features=2)
    if block != 8 << 20:
        datasets, groups = A.dataset_vectors(tables[1], NAMES, comparison.fit()), comparison.groups("grp")
        monkeypatch.setattr(A, "_group_blocks", _small(A._group_blocks, block))
        monkeypatch.setattr(A, "_dataset_blocks", _small(A._dataset_blocks, block))
        scores = A.best_groups(groups, datasets, P, 4, method)
    else:
        scores = report.scores
    got = {}
    for r in scores.collect():
        got.setdefault(r.dataset_name, {})[r.rank] = r
    assert len(got) == 42
    differences = report.key_differences.collect()
    for name in ("d0", "d17", "d39", "d gap", "far"):
        one = comparison.compare_to_groups("grp", name, comparison_method=method, top_n_features=2)
        want = one.scores.filter("rank <= 4").collect()
        assert len(got[name]) == 4
        for w in want:
            g = got[name][w["rank"]]
            assert (g.grp, g.method_used) == (w.grp, w.method_used)
            for a, b in ((g.distance, w.distance), (g.similarity, w.similarity)):
                assert (a is None and b is None) or a == pytest.approx(b, rel=1e-9)
        kept = [w.grp for w in want]
        top = {(r.grp, r["rank"]): r for r in one.key_differences.filter(F.col("grp").isin(kept)).collect()}
        mine = {(r.grp, r["rank"]): r for r in differences if r.dataset_name == name}
        if block == 8 << 20:
            assert mine.keys() == top.keys()
            for k, w in top.items():
                assert (mine[k].feature, mine[k].pos) == (w.feature, w.pos)
                assert mine[k].contribution == pytest.approx(w.contribution)


def _small(f, block):
    def run(*args):
        from lexigauge.operators import compare_all

        before, compare_all.BLOCK_BYTES = compare_all.BLOCK_BYTES, block
        try:
            yield from f(*args)
        finally:
            compare_all.BLOCK_BYTES = before

    return run


def test_factors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, P))
    cov, mean = np.cov(x.T), x.mean(axis=0)
    for matrix in (cov, cov - 0.9 * np.eye(P)):  # the second has negative eigenvalues
        w, signs = A.factor(mean, matrix)
        for u in rng.normal(size=(5, P)):
            white = w @ (u - mean)
            assert signs @ (white * white) == pytest.approx((u - mean) @ np.linalg.inv(matrix) @ (u - mean))
    assert A.factor(mean, np.ones((P, P))) is None
    assert A.factor(mean, np.full((P, P), np.nan)) is None


def test_ties_go_to_the_smaller_name(spark):
    mean, cov = [0.0, 0.0], [[1.0, 0.0], [0.0, 1.0]]
    rows = [(g, mean, cov) for g in ("é", "b", "a", "Z")] + [("far", [9e3, 9e3], cov), ("farther", [9e4, 9e4], cov)]
    groups = spark.createDataFrame(rows, "grp string, mean array<double>, cov array<array<double>>")
    datasets = spark.createDataFrame([("u", [0.5, 0.5])], "dataset_name string, mean array<double>")
    got = A.best_groups(groups, datasets, 2, top_n=6).orderBy("rank").collect()
    assert [r.grp for r in got] == ["Z", "a", "b", "é", "far", "farther"]
    # similarities of 0 are ties too, as in the ranking of one dataset
    assert [r.similarity for r in got[4:]] == [0.0, 0.0]


def test_no_pairs_in_the_plan(tables):
    """Datasets meet groups in blocks: no cross join, no ordering over all rows, features only of kept pairs."""
    comparison = Comparison(*tables, NAMES)
    groups, datasets = comparison.groups("grp"), A.dataset_vectors(tables[1], NAMES, comparison.fit())
    plan = physical(A.best_groups(groups, datasets, P))
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan
    report = comparison.compare_all_to_groups("grp")
    assert "Window" not in optimized(report.key_differences)


def test_nothing_to_compare(spark, tables):
    master, user = tables
    none = user.limit(0)
    assert Comparison(master, none, NAMES).compare_all_to_groups("grp").scores.collect() == []
    assert Comparison(master.filter("grp IS NULL"), user, NAMES).compare_all_to_groups("grp").scores.collect() == []
    with pytest.raises(ValueError):
        Comparison(master, user, NAMES).compare_all_to_groups("grp", comparison_method="cosine")


def test_wide_tables(spark):
    rng = np.random.default_rng(4)
    names = [f"w{i}" for i in range(12)]
    rows = [(f"g{i % 3}", f"d{i % 7}", *map(float, rng.normal(size=12))) for i in range(210)]
    df = spark.createDataFrame(rows, ["grp", "dataset_name", *names])
    comparison = Comparison(df, df, names)
    got = {(r.dataset_name, r["rank"]): r for r in comparison.compare_all_to_groups("grp", top_n_groups=3).scores.collect()}
    assert len(got) == 21
    for w in comparison.compare_to_groups("grp", "d3").scores.collect():
        assert got["d3", w["rank"]].grp == w.grp and got["d3", w["rank"]].distance == pytest.approx(w.distance)
