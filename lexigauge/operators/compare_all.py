"""All datasets against all groups in one job.

Datasets go in blocks of rows, groups in blocks of factors. A group's factor turns the distance into a plain
norm: with L the Cholesky factor of its covariance, |L^-1 (u - m)| is the Mahalanobis distance of u and m. A block of datasets
meets each block of groups once, as two matrices; of every meeting only the best groups of each dataset come out, so
no row stands for every pair, and the features of a pair are looked at only if it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.fixed_values import STD_GUARD
from lexigauge.operators.moments import feature_columns
from lexigauge.session import materialize

#: Bytes of a block of datasets and of a block of groups.
BLOCK_BYTES = 8 << 20

_BLOCK = "block int, n int, names binary, data binary"
_BEST = "dataset_name string, grp string, distance double, method_used string, similarity double"


def dataset_vectors(user: DataFrame, features: list[str], fit: DataFrame, name_column: str = "dataset_name") -> DataFrame:
    """`(dataset_name, n_rows, mean)` of standardised features, one row for each dataset; null names are left out."""
    quoted = F.col("`" + name_column.replace("`", "``") + "`")
    rows = user.filter(quoted.isNotNull()).select(quoted.cast("string").alias("dataset_name"), *feature_columns(features))
    names = [f"f{i}" for i in range(len(features))]
    raw = rows.groupBy("dataset_name").agg(F.count("*").alias("n_rows"), F.array(*[F.avg(c) for c in names]).alias("mean"))
    known = raw.withColumn("_fit", fit.select(F.struct("mean", "scale")).scalar())
    centred = F.zip_with(F.col("mean"), F.col("_fit.mean"), lambda x, m: x - m)
    return known.select("dataset_name", "n_rows", F.zip_with(centred, F.col("_fit.scale"), lambda x, s: x / s).alias("mean"))


def factor(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(w, signs) with distance^2 = sum(signs * (w (u - mean))^2); None where Mahalanobis is undefined."""
    if not (np.isfinite(mean).all() and np.isfinite(cov).all()) or np.linalg.matrix_rank(cov, hermitian=True) < len(cov):
        return None
    try:
        return np.linalg.solve(np.linalg.cholesky(cov), np.eye(len(cov))), np.ones(len(cov))
    except np.linalg.LinAlgError:
        # moments of incomplete rows need not be a covariance; their inverse may still give a distance
        values, vectors = np.linalg.eigh(cov)
        return vectors.T / np.sqrt(np.abs(values))[:, None], np.sign(values)


def _packed(floats: int, batches: Iterator[pa.RecordBatch], row_of) -> Iterator[pa.RecordBatch]:
    """Rows put into blocks of BLOCK_BYTES: (block, n, names, data); `block` is set later."""
    most = max(1, BLOCK_BYTES // (8 * floats))
    names, data = [], []

    def block() -> pa.RecordBatch:
        packed = pa.array(names, pa.string())
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([packed], names=["name"])
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        columns = [[0], [len(names)], [sink.getvalue().to_pybytes()], [np.concatenate(data).tobytes()]]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["block", "n", "names", "data"])

    for batch in batches:
        for row in batch.to_pylist():
            names.append(row["name"])
            data.append(row_of(row))
            if len(names) >= most:
                yield block()
                names, data = [], []
    if names:
        yield block()


def _unpacked(names: bytes) -> list[str]:
    return pa.ipc.open_stream(names).read_all().column(0).to_pylist()


def _vector(values: list) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in values], dtype="float64")


def _dataset_blocks(p: int, batches):
    return _packed(p, batches, lambda row: _vector(row["mean"]))


def _group_blocks(p: int, mahalanobis: bool, batches):
    """Of each group: whether it has a factor, the mean, the signs and the factor, or nothing in place of these."""

    def of(row):
        mean = _vector(row["mean"])
        found = None
        if mahalanobis and row["cov"] is not None:
            found = factor(mean, np.array([_vector(r) for r in row["cov"]]))
        signs, w = (np.zeros(p), np.zeros(p * p)) if found is None else (found[1], found[0].ravel())
        return np.concatenate([[found is not None], mean, signs, w])

    return _packed(1 + 2 * p + p * p, batches, of)


def _meet(p: int, top_n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of datasets and one of groups to the best groups of each dataset in it."""
    for batch in batches:
        for row in batch.to_pylist():
            users, groups = _unpacked(row["names"]), _unpacked(row["group_names"])
            u = np.frombuffer(row["data"], "float64").reshape(len(users), p)
            g = np.frombuffer(row["group_data"], "float64").reshape(len(groups), -1)
            # ties go to the smaller name
            by_name = sorted(range(len(groups)), key=lambda k: groups[k].encode())
            distance, skewed = np.empty((len(users), len(groups))), np.zeros((len(users), len(groups)), bool)
            for at, k in enumerate(by_name):
                mean, signs, w = g[k, 1 : 1 + p], g[k, 1 + p : 1 + 2 * p], g[k, 1 + 2 * p :].reshape(p, p)
                apart = u - mean
                straight = np.sqrt((apart * apart).sum(axis=1))
                if g[k, 0]:
                    white = apart @ w.T
                    square = (white * white) @ signs
                    usable = np.isfinite(square) & (square >= 0)
                    distance[:, at] = np.where(usable, np.sqrt(np.where(usable, square, 0.0)), straight)
                    skewed[:, at] = usable
                else:
                    distance[:, at] = straight
            similarity = np.exp(-distance)
            best = np.argsort(np.where(np.isnan(similarity), np.inf, -similarity), axis=1, kind="stable")[:, :top_n]
            rows = np.repeat(np.arange(len(users)), best.shape[1])
            at = best.ravel()
            d, s = distance[rows, at], similarity[rows, at]
            names = pa.array([groups[k] for k in by_name], pa.string())
            methods = pa.array(["euclidean", "mahalanobis"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(users, pa.string()).take(pa.array(rows)),
                    names.take(pa.array(at)),
                    pa.array(d, mask=np.isnan(d)),
                    methods.take(pa.array(skewed[rows, at].astype("int8"))),
                    pa.array(s, mask=np.isnan(s)),
                ],
                names=["dataset_name", "grp", "distance", "method_used", "similarity"],
            )


def _numbered(blocks: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Written blocks with numbers from 0, and how many there are: one row for some megabytes."""
    rows = materialize(blocks.withColumn("at", F.monotonically_increasing_id()), name)
    places = sorted(r.at for r in rows.select("at").toLocalIterator())
    if not places:
        return rows.drop("at"), 0
    number = F.array_position(F.lit(places), F.col("at")).cast("int") - 1
    return rows.withColumn("block", number).drop("at"), len(places)


def best_groups(groups: DataFrame, datasets: DataFrame, p: int, top_n: int = 3, method: str = "mahalanobis") -> DataFrame:
    """`(dataset_name, grp, distance, method_used, similarity, rank)`: the `top_n` groups of every dataset.

    groups: `(grp, mean, cov)`, datasets: `(dataset_name, mean)`, standardised; ranks and methods are those
    of `compare.group_distances` and `compare.ranked_groups`.
    """
    if method not in ("mahalanobis", "euclidean"):
        raise ValueError("method must be 'mahalanobis' or 'euclidean'")
    parts = groups.filter("grp IS NOT NULL").select(F.col("grp").alias("name"), "mean", "cov")
    parts = parts.mapInArrow(partial(_group_blocks, p, method == "mahalanobis"), _BLOCK)
    of_groups, n_blocks = _numbered(parts, "group_blocks")
    of_datasets = datasets.select(F.col("dataset_name").alias("name"), "mean").mapInArrow(partial(_dataset_blocks, p), _BLOCK)
    # every block of datasets goes to every block of groups; nothing is paired row by row
    places = F.sequence(F.lit(0), F.lit(n_blocks - 1)) if n_blocks else F.array().cast("array<int>")
    sent = of_datasets.drop("block").withColumn("block", F.explode(places))
    other = of_groups.select("block", F.col("names").alias("group_names"), F.col("data").alias("group_data"))
    met = sent.join(other, "block").mapInArrow(partial(_meet, p, top_n), _BEST)
    order = Window.partitionBy("dataset_name").orderBy(F.col("similarity").desc_nulls_last(), F.col("grp"))
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)


def top_differences(best: DataFrame, groups: DataFrame, datasets: DataFrame, features: list[str], top_n: int = 3) -> DataFrame:
    """`(dataset_name, grp, pos, feature, user_value, group_mean, z_score, contribution, rank)` of the kept pairs.

    A pair's features are ordered and cut within its row.
    """
    pairs = best.select("dataset_name", "grp").join(datasets.select("dataset_name", F.col("mean").alias("user")), "dataset_name")
    pairs = pairs.join(groups.select("grp", "mean", "std"), "grp")
    labels = F.array(*[F.lit(f) for f in features])
    each = F.transform(F.arrays_zip(labels.alias("feature"), F.col("user").alias("u"), F.col("mean").alias("m"), F.col("std").alias("s")), _difference)
    # null contributions come last; ties in feature order
    order = F.transform(each, lambda e: F.struct(e["contribution"].isNull().alias("none"), (-e["contribution"]).alias("key"), e["pos"].alias("pos"), e.alias("e")))
    first = F.slice(F.array_sort(order), 1, top_n)
    out = pairs.select("dataset_name", "grp", F.posexplode(first).alias("at", "d"))
    return out.select("dataset_name", "grp", "d.e.*", (F.col("at") + 1).alias("rank"))


def _difference(x: Column, pos: Column) -> Column:
    z_score = (x["u"] - x["m"]) / (x["s"] + F.lit(STD_GUARD))
    return F.struct(
        pos.alias("pos"), x["feature"].alias("feature"), x["u"].alias("user_value"), x["m"].alias("group_mean"),
        z_score.alias("z_score"), (F.abs(z_score) * x["s"]).alias("contribution"),
    )
