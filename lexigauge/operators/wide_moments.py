"""Moments of wide feature tables in one scan.

A task holds rows until they fill BUFFER_BYTES, then reduces each group among them to co-moments: counts, means
and centred sums of products of every feature pair, by tiles of TILE x TILE features. Groups with fewer
rows than a tile is wide go on as rows, which are smaller. Parts meet sorted by (group, tile) and are merged one by one,
so neither many groups in a task nor a hot group need more memory than a buffer and a few tiles.

Centred moments are merged by their means, so no common shift and no first scan for one is needed. A pair's
moments are those of the rows that have both features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigauge.operators.moments import feature_columns, scale_of
from lexigauge.session import materialize

TILE = 256
BUFFER_BYTES = 64 << 20

#: A part of a group's tile: `kind` 0 for rows, 1 for moments of complete rows, 2 for moments with a count for each pair.
_PART = "grp string, left int, right int, n_rows long, kind int, data binary"
_GROUP = """grp string, n_rows long, mean array<double>, std array<double>, cov array<array<double>>,
            n array<double>, square array<double>, low array<double>, high array<double>"""


@dataclass
class Moments:
    """Of pairs of a left and a right block of features.

    n, left, right: one count and two mean vectors if every row has all features, else a matrix each. co:
    centred sums of products. low, high: of the left features, NaN without a value.
    """

    n: np.ndarray
    left: np.ndarray
    right: np.ndarray
    co: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Moments:
        has_x, has_y = ~np.isnan(x), ~np.isnan(y)
        low, high = np.fmin.reduce(x, axis=0), np.fmax.reduce(x, axis=0)
        if has_x.all() and has_y.all():
            left, right = x.mean(axis=0), y.mean(axis=0)
            return cls(np.float64(len(x)), left, right, (x - left).T @ (y - right), low, high)
        near_x, near_y = _centre(x, has_x), _centre(y, has_y)
        dx, dy = np.where(has_x, x - near_x, 0.0), np.where(has_y, y - near_y, 0.0)
        px, py = has_x.astype("float64"), has_y.astype("float64")
        n = px.T @ py
        some = np.maximum(n, 1)
        sx, sy = dx.T @ py, px.T @ dy
        left, right = near_x[:, None] + sx / some, near_y[None, :] + sy / some
        return cls(n, left, right, dx.T @ dy - sx * sy / some, low, high)

    def full(self) -> Moments:
        """With a matrix for each part."""
        if self.n.ndim:
            return self
        shape = self.co.shape
        left, right = np.broadcast_to(self.left[:, None], shape), np.broadcast_to(self.right[None, :], shape)
        return Moments(np.full(shape, self.n), left, right, self.co, self.low, self.high)

    def merged(self, other: Moments) -> Moments:
        low, high = np.fmin(self.low, other.low), np.fmax(self.high, other.high)
        if self.n.ndim == 0 and other.n.ndim == 0:
            n = self.n + other.n
            part = other.n / n
            dx, dy = other.left - self.left, other.right - self.right
            co = self.co + other.co + np.outer(dx, dy) * (self.n * part)
            return Moments(n, self.left + dx * part, self.right + dy * part, co, low, high)
        a, b = self.full(), other.full()
        n = a.n + b.n
        part = b.n / np.maximum(n, 1)
        dx, dy = b.left - a.left, b.right - a.right
        # a side without rows has no mean: the other side's is taken whole
        dx, dy = np.where(a.n * b.n > 0, dx, 0.0), np.where(a.n * b.n > 0, dy, 0.0)
        left, right = np.where(a.n > 0, a.left, b.left) + dx * part, np.where(a.n > 0, a.right, b.right) + dy * part
        return Moments(n, left, right, a.co + b.co + dx * dy * a.n * part, low, high)

    def packed(self) -> tuple[int, bytes]:
        parts = (self.n, self.left, self.right, self.co, self.low, self.high)
        return (2 if self.n.ndim else 1), b"".join(np.ascontiguousarray(v, "float64").tobytes() for v in parts)

    @classmethod
    def unpacked(cls, kind: int, data: bytes, height: int, width: int) -> Moments:
        cells = height * width
        sizes = (1, height, width, cells, height, height) if kind == 1 else (cells, cells, cells, cells, height, height)
        n, left, right, co, low, high = np.split(np.frombuffer(data, "float64"), np.cumsum(sizes)[:-1])
        shape = (height, width)
        if kind == 1:
            return cls(n[0], left, right, co.reshape(shape), low, high)
        return cls(n.reshape(shape), left.reshape(shape), right.reshape(shape), co.reshape(shape), low, high)


def _centre(x: np.ndarray, has: np.ndarray) -> np.ndarray:
    """The mean of what each column has, 0 without any."""
    return np.where(has, x, 0.0).sum(axis=0) / np.maximum(has.sum(axis=0), 1)


def _blocks(p: int) -> list[slice]:
    return [slice(a, min(a + TILE, p)) for a in range(0, p, TILE)]


def _tiles(p: int) -> list[tuple[int, int, slice, slice]]:
    blocks = _blocks(p)
    return [(i, j, blocks[i], blocks[j]) for i in range(len(blocks)) for j in range(i, len(blocks))]


def _batch(rows: list[tuple], schema: list[str]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema)


_NAMES = ["grp", "left", "right", "n_rows", "kind", "data"]


def _in_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Parts in batches of bounded bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 64
        if size >= BUFFER_BYTES // 8:
            yield _batch(held, _NAMES)
            held, size = [], 0
    if held:
        yield _batch(held, _NAMES)


def partial_moments(p: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, features as a list) to parts of each group and tile."""

    def reduced(groups: list, values: list) -> Iterator[tuple]:
        coded = pa.chunked_array(groups).combine_chunks().dictionary_encode()
        names = [*coded.dictionary.to_pylist(), None]
        codes = coded.indices.fill_null(len(names) - 1).to_numpy()
        order = np.argsort(codes, kind="stable")
        found, starts = np.unique(codes[order], return_index=True)
        x = np.concatenate(values)[order]
        for code, a, b in zip(found, starts, [*starts[1:], len(x)]):
            for i, j, left, right in _tiles(p):
                if b - a < min(left.stop - left.start, right.stop - right.start):
                    kind, data = 0, np.concatenate([x[a:b, left], x[a:b, right]], axis=1).tobytes()
                else:
                    kind, data = Moments.of(x[a:b, left], x[a:b, right]).packed()
                yield names[code], i, j, int(b - a), kind, data

    groups, values, size = [], [], 0
    for batch in batches:
        if batch.num_rows:
            groups.append(batch.column(0))
            values.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, p))
            size += values[-1].nbytes
        if size >= BUFFER_BYTES:
            yield from _in_batches(reduced(groups, values))
            groups, values, size = [], [], 0
    if groups:
        yield from _in_batches(reduced(groups, values))


def merge_moments(p: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each group and tile from parts sorted by these."""
    blocks = _blocks(p)

    def merged() -> Iterator[tuple]:
        key, total, rows, held = None, None, 0, []

        def settled():
            if not held:
                return total
            x = np.concatenate(held)
            height = blocks[key[1]].stop - blocks[key[1]].start
            new = Moments.of(x[:, :height], x[:, height:])
            return new if total is None else total.merged(new)

        for batch in batches:
            for grp, i, j, n, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (grp, i, j):
                    if key is not None:
                        yield (*key, rows, *settled().packed())
                    key, total, rows, held = (grp, i, j), None, 0, []
                rows += n
                height, width = (blocks[k].stop - blocks[k].start for k in (i, j))
                if kind == 0:
                    held.append(np.frombuffer(data, "float64").reshape(n, height + width))
                    if sum(map(len, held)) >= TILE:
                        total, held = settled(), []
                else:
                    new = Moments.unpacked(kind, data, height, width)
                    total = new if total is None else total.merged(new)
        if key is not None:
            yield (*key, rows, *settled().packed())

    yield from _in_batches(merged())


def _nested(rows: list[np.ndarray]) -> pa.Array:
    """Vectors as lists, NaN as null."""
    flat = np.concatenate(rows)
    offsets = np.append(0, np.cumsum([len(r) for r in rows])).astype("int32")
    return pa.ListArray.from_arrays(offsets, pa.array(flat, mask=np.isnan(flat)))


def whole_groups(p: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a group from its tiles, sorted by group."""
    blocks = _blocks(p)

    def finished(grp, rows: int, tiles: dict) -> pa.RecordBatch:
        n, mean, co = np.zeros((p, p)), np.full(p, np.nan), np.zeros((p, p))
        low, high = np.full(p, np.nan), np.full(p, np.nan)
        for (i, j), m in tiles.items():
            m = m.full()
            n[blocks[i], blocks[j]], co[blocks[i], blocks[j]] = m.n, m.co
            n[blocks[j], blocks[i]], co[blocks[j], blocks[i]] = m.n.T, m.co.T
            if i == j:
                mean[blocks[i]] = np.where(np.diag(m.n) > 0, np.diag(m.left), np.nan)
                low[blocks[i]], high[blocks[i]] = m.low, m.high
        cov = np.where(n > 1, co / np.maximum(n - 1, 1), np.nan)
        own = np.diag(n).copy()
        square = np.maximum(np.diag(co), 0.0)
        std = np.where(own > 1, np.sqrt(square / np.maximum(own - 1, 1)), np.nan)
        matrix = pa.ListArray.from_arrays(pa.array([0, p], pa.int32()), _nested(list(cov)))
        vectors = [_nested([v]) for v in (mean, std)], [_nested([v]) for v in (own, square, low, high)]
        columns = [pa.array([grp], pa.string()), pa.array([rows]), *vectors[0], matrix, *vectors[1]]
        return pa.RecordBatch.from_arrays(columns, names=["grp", "n_rows", "mean", "std", "cov", "n", "square", "low", "high"])

    key, rows, tiles = (), 0, {}
    for batch in batches:
        for grp, i, j, n, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (grp,):
                if key:
                    yield finished(*key, rows, tiles)
                key, tiles = (grp,), {}
            rows = n
            height, width = (blocks[k].stop - blocks[k].start for k in (i, j))
            tiles[i, j] = Moments.unpacked(kind, data, height, width)
    if key:
        yield finished(*key, rows, tiles)


def wide_group_summary(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Moments of every group and of the whole table: `(is_total, grp, n_rows, mean, std, scale, cov)`.

    The same rows as `moments.group_summary` for any number of features, null group included; the
    total's covariance is left null. Rows are read once; what is kept is written, one row a group.
    """
    p = len(features)
    quoted = "`" + group.replace("`", "``") + "`"
    rows = df.select(F.col(quoted).cast("string").alias("grp"), F.array(*feature_columns(features)).alias("x"))
    tile, key = ["grp", "left", "right"], ["grp"]
    parts = rows.mapInArrow(partial(partial_moments, p), _PART)
    tiles = parts.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(partial(merge_moments, p), _PART)
    if p > TILE:
        # a group's tiles were merged apart
        tiles = tiles.repartition(*key).sortWithinPartitions(*key)
    groups = materialize(tiles.mapInArrow(partial(whole_groups, p), _GROUP), "groups")
    nothing = F.lit(None).cast("array<array<double>>")
    parted = groups.select(F.lit(False).alias("is_total"), "grp", "n_rows", "mean", "std", F.lit(None).cast("array<double>").alias("scale"), "cov")
    return parted.unionByName(_total(groups).withColumn("cov", nothing))


def _total(groups: DataFrame) -> DataFrame:
    """One row: the groups' features put together by counts, means and squares."""
    long = groups.select(F.posexplode(F.arrays_zip("n", "mean", "square", "low", "high")).alias("pos", "e")).select("pos", "e.*")
    # NaN never comes out of the groups; a feature without a value has a null mean
    level = long.groupBy("pos").agg(F.sum("n").alias("all"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum(F.when(F.col("mean").isNotNull(), F.col("n")))).alias("level"), F.min("low").alias("least"), F.max("high").alias("most"))
    apart = F.col("mean") - F.col("level")
    spread = long.join(level, "pos").groupBy("pos").agg(
        F.max("all").alias("all"), F.max("level").alias("mean"), F.max("least").alias("least"), F.max("most").alias("most"),
        F.sum(F.col("square") + F.coalesce(F.col("n") * apart * apart, F.lit(0.0))).alias("square"),
    )
    deviation = F.sqrt(F.try_divide(F.col("square"), F.col("all")))
    each = spread.select(
        "pos", "mean", F.when(F.col("all") > 1, F.sqrt(F.col("square") / (F.col("all") - 1))).alias("std"),
        scale_of(deviation, F.col("least"), F.col("most")).alias("scale"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean", "std", "scale")))
    packed = each.agg(ordered.alias("by_pos"))
    counted = groups.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
    whole = packed.withColumn("n_rows", counted.scalar())
    return whole.select(F.lit(True).alias("is_total"), F.lit(None).cast("string").alias("grp"), "n_rows", *(F.col("by_pos")[k].alias(k) for k in ("mean", "std", "scale")))
