"""Moments of wide tables against NumPy, against Spark's own aggregates, and their cost."""

import tracemalloc
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigauge.operators import moments as M
from lexigauge.operators import wide_moments as W
from lexigauge.plans.comparison import fitted_groups, summary_of
from tests.conftest import physical


def names(p):
    return [f"f{i}" for i in range(p)]


def frame(spark, groups, x, parts=5):
    rows = [(g, *(None if np.isnan(v) else float(v) for v in r)) for g, r in zip(groups, x)]
    return spark.createDataFrame(rows, f"grp string, {', '.join(n + ' double' for n in names(x.shape[1]))}").repartition(parts)


def values(array):
    return np.array([np.nan if v is None else v for v in array], dtype="float64")


SIZES = [(256, 64 << 20), (4, 1), (3, 64 << 20)]


@pytest.mark.parametrize("missing,tile,buffer", [(0.0, 4, 4000), *((m, *s) for m in (0.0, 0.2, 0.9) for s in SIZES)])
def test_as_spark_has_them(spark, monkeypatch, missing, tile, buffer):
    """All group rows, the null group's too, and the total; tiles and flushes of any size."""
    rng = np.random.default_rng(int(10 * missing) + tile)
    p = 7
    x = rng.normal(size=(160, p)) * 10.0 ** rng.integers(-3, 4, p) + 1e4 * rng.normal(size=p)
    x[rng.random(x.shape) < missing] = np.nan
    x[:, 5], x[:, 6] = 4.0, np.nan
    groups = [["hot", "hot", "b", None, f"g{i}"][i % 5] for i in range(160)]
    df = frame(spark, groups, x)
    want = {(r.is_total, r.grp): r for r in M.group_summary(df, "grp", names(p)).collect()}
    monkeypatch.setattr(W, "TILE", tile)
    # functions that go to tasks as closures take the sizes along
    monkeypatch.setattr(W, "partial_moments", _with(W.partial_moments, tile, buffer))
    monkeypatch.setattr(W, "merge_moments", _with(W.merge_moments, tile, buffer))
    monkeypatch.setattr(W, "whole_groups", _with(W.whole_groups, tile, buffer))
    got = {(r.is_total, r.grp): r for r in W.wide_group_summary(df, "grp", names(p)).collect()}
    assert got.keys() == want.keys()
    for key, w in want.items():
        g = got[key]
        assert g.n_rows == w.n_rows
        for field in ("mean", "std"):
            assert values(g[field]) == pytest.approx(values(w[field]), rel=1e-9, abs=1e-9, nan_ok=True)
        if key[0]:
            assert values(g.scale) == pytest.approx(values(w.scale), rel=1e-9, nan_ok=True)
        else:
            for a, b in zip(g.cov, w.cov):
                assert values(a) == pytest.approx(values(b), rel=1e-7, abs=1e-7, nan_ok=True)


def _with(f, tile, buffer):
    def run(p, batches):
        from lexigauge.operators import wide_moments

        before = wide_moments.TILE, wide_moments.BUFFER_BYTES
        wide_moments.TILE, wide_moments.BUFFER_BYTES = tile, buffer
        try:
            yield from f(p, batches)
        finally:
            wide_moments.TILE, wide_moments.BUFFER_BYTES = before

    return run


def test_far_from_zero(spark):
    """Sums of squares would lose every digit."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 12)) + 1e9
    groups = ["a" if i % 2 else "b" for i in range(600)]
    for r in W.wide_group_summary(frame(spark, groups, x), "grp", names(12)).filter("NOT is_total").collect():
        own = x[[g == r.grp for g in groups]]
        assert np.array(r.cov) == pytest.approx(np.cov(own.T), rel=1e-5, abs=1e-6)


def test_512_features(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 512)) @ np.diag(rng.random(512) + 0.5)
    groups = [f"g{i % 3}" for i in range(900)]
    rows = [(g, r.tolist()) for g, r in zip(groups, x)]
    df = spark.createDataFrame(rows, "grp string, v array<double>").repartition(4)
    df = df.selectExpr("grp", *[f"v[{i}] AS f{i}" for i in range(512)])
    fit, scaled = fitted_groups(df, "grp", names(512))
    assert np.array(fit.first().scale) == pytest.approx(x.std(axis=0))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    for r in scaled.collect():
        assert np.array(r.cov) == pytest.approx(np.cov(z[[g == r.grp for g in groups]].T), abs=1e-9)


@pytest.mark.parametrize("p,n_groups,per_group", [(64, 10_000, 30), (512, 10_000, 2)])
def test_memory_of_many_groups_in_a_task(p, n_groups, per_group):
    rng = np.random.default_rng(5)

    def batches():
        for _ in range(per_group * n_groups // 10_000):
            for _ in range(10):
                codes = rng.integers(0, n_groups, 1000)
                flat = pa.array(rng.normal(size=1000 * p))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 1001 * p, p, dtype="int32")), flat)
                yield pa.RecordBatch.from_arrays([pa.array([f"g{c}" for c in codes]), lists], names=["grp", "x"])

    tracemalloc.start()
    pa_before = pa.total_allocated_bytes()
    rows, largest = 0, 0
    for part in W.partial_moments(p, batches()):
        largest = max(largest, pa.total_allocated_bytes() - pa_before)
        rows += sum(n for n, i, j in zip(part.column(3).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()) if i == j == 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == per_group * n_groups
    assert peak + largest < 500e6


def test_parts_are_the_smaller_form():
    """Groups with fewer rows than a tile is wide go on as rows."""
    x = np.arange(40.0).reshape(10, 4)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 41, 4, dtype="int32")), pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 7 + ["b"] * 3), lists], names=["grp", "x"])
    (out,) = W.partial_moments(4, iter([batch]))
    assert dict(zip(out.column(0).to_pylist(), out.column(4).to_pylist())) == {"a": 1, "b": 0}


def test_one_scan(spark, tmp_path, monkeypatch):
    """Fit and moments of a wide table come from one read of it."""
    rng = np.random.default_rng(6)
    path = str(tmp_path / "wide")
    frame(spark, ["a", "b"] * 50, rng.normal(size=(100, 20))).write.parquet(path)
    scans = []
    kept = W.materialize

    def watched(df, name):
        scans.append(physical(df).count("FileScan parquet"))
        return kept(df, name)

    monkeypatch.setattr(W, "materialize", watched)
    fit, scaled = fitted_groups(spark.read.parquet(path), "grp", names(20))
    assert scans == [1]
    for df in (fit, scaled):
        assert path not in physical(df)


def test_null_group_at_8_and_9_features(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 9))
    groups = [("a", "b", None)[i % 3] for i in range(60)]
    df = frame(spark, groups, x)
    for p in (8, 9):
        rows = {r.grp: r.n_rows for r in summary_of(df, "grp", names(p)).filter("NOT is_total").collect()}
        assert rows == {"a": 20, "b": 20, None: 20}


def test_no_rows(spark):
    df = spark.createDataFrame([], f"grp string, {', '.join(n + ' double' for n in names(9))}")
    (row,) = W.wide_group_summary(df, "grp", names(9)).collect()
    assert row.is_total and row.n_rows == 0


def test_names_with_marks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "`my``grp` string, `f.x` double")
    rows = W.wide_group_summary(df, "my`grp", ["f.x"]).filter(~F.col("is_total")).collect()
    assert [(r.grp, r.mean) for r in rows] == [("a", [1.5])]
