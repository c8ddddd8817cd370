"""SimHash fingerprints of word shingles, and their near-duplicates by vantage-point trees.

Two fingerprints of 64 bits that differ in at most 4 bits differ in at most 1 bit in one of three
windows of 22, 21 and 21 bits. So there is one tree for each window. A node of a tree holds a
vantage point and a radius: fingerprints within the radius (Hamming distance in the window) go to
its inner child, the others to the outer one; the leaves are shards. A fingerprint is searched in
every leaf that its ball of 1 bit touches, which the triangle bounds at each node tell: at distance
d from the vantage point, the inner side is pruned if d - 1 is beyond the radius, the outer side if
d + 1 is not. In a leaf all its fingerprints are compared on 64 bits with its visitors, so all
links are exact and none is missed.

The trees are fitted on a bounded sample of distinct fingerprints; every fingerprint is indexed.
Equal fingerprints are taken together before. A leaf that holds more than CHUNK fingerprints is cut into
chunks, each of which meets all visitors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import arrow_batches, arrow_rows, arrow_schema, free_name, small_batches, with_fields
from .components import connected_components

WORDS = 4
SEED = 42
BITS = 4
#: (lowest bit, width) of the windows; a ball of RADIUS bits in one of them holds each link.
WINDOWS = ((0, 22), (22, 21), (43, 21))
RADIUS = BITS // len(WINDOWS)
#: Fingerprints on which the trees are fitted, by smallest hash.
SAMPLE = 1 << 16
#: Fingerprints a leaf should hold, and those compared at once.
LEAF = 2000
CHUNK = 8000


def fingerprint(text: str) -> int:
    """The 64 bits of one text, signed. Words are split at ASCII white space, A-Z lower-cased."""
    return _fingerprints([text])[0].item()


def _hashes(text: str) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if len(words) <= WORDS:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(words) - WORDS])]
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :], strict=True)], np.uint64)


def _fingerprints(texts: list[str | None], block: int = 1 << 16) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        h = _hashes(text or "")
        if len(h):
            ones = np.zeros(64, np.int64)
            for a in range(0, len(h), block):
                part = h[a : a + block].astype(">u8").view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > len(h)).view(">u8")[0]
    return out.view(np.int64)


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "simhash") -> DataFrame:
    """`docs` with the SimHash of each whole text as a long; 0 for a null text and one without words."""
    small_batches(docs.sparkSession)
    schema = with_fields(docs, (out, T.LongType()))
    fields = arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            found = _fingerprints(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield arrow_rows(batch, fields, **{out: found})

    return docs.mapInArrow(run, schema)


@dataclass
class Node:
    """A leaf has a number; an inner node a vantage point, a radius and two children."""

    leaf: int = -1
    point: int = 0
    radius: int = 0
    inner: "Node | None" = None
    outer: "Node | None" = None


def grow(values: np.ndarray, most: int) -> tuple[Node, int]:
    """A tree over a window's values whose leaves hold at most `most` of them, and its number of leaves.

    Of a few values tried, that one is the vantage point on whose boundary the fewest values lie.
    """
    rng = np.random.default_rng(0)
    leaves = 0

    def split(v: np.ndarray) -> Node:
        nonlocal leaves
        best = None
        if len(v) > most:
            for point in rng.choice(v, min(8, len(v)), replace=False):
                d = np.bitwise_count(v ^ point)
                radius = int(np.median(d))
                inside = int((d <= radius).sum())
                if inside == len(v):
                    radius -= 1
                    inside = int((d <= radius).sum())
                if 0 < inside < len(v):
                    cost = ((d > radius - RADIUS) & (d <= radius + RADIUS)).mean() + abs(2 * inside / len(v) - 1)
                    if best is None or cost < best[0]:
                        best = (cost, int(point), radius, d <= radius)
        if best is None:
            leaves += 1
            return Node(leaf=leaves - 1)
        _, point, radius, inside = best
        return Node(point=point, radius=radius, inner=split(v[inside]), outer=split(v[~inside]))

    return split(values), leaves


def visit(tree: Node, values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, indices of the values searched in it, whether it is their home)."""
    stack = [(tree, np.arange(len(values)), np.ones(len(values), bool))]
    while stack:
        node, rows, home = stack.pop()
        if node.leaf >= 0:
            yield node.leaf, rows, home
            continue
        d = np.bitwise_count(values[rows] ^ np.uint64(node.point)).astype(np.int64)
        inside = d - RADIUS <= node.radius
        outside = d + RADIUS > node.radius
        stack.append((node.inner, rows[inside], (home & (d <= node.radius))[inside]))
        stack.append((node.outer, rows[outside], (home & (d > node.radius))[outside]))


def window(values: np.ndarray, k: int) -> np.ndarray:
    low, width = WINDOWS[k]
    return (values.view(np.uint64) >> np.uint64(low)) & np.uint64((1 << width) - 1)


def leaf_links(fps: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever the pairs of a home fingerprint and any other within BITS connect.

    A link is only kept if it joins two groups that were apart, so a dense group of n gives n - 1.
    """
    group = np.arange(len(fps))
    a, b = [], []
    for i in np.flatnonzero(home):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= BITS)
        groups, first = np.unique(group[near], return_index=True)
        if len(groups) > 1:
            for j in near[first]:
                if j != i:
                    a.append(i)
                    b.append(j)
            group[np.isin(group, groups)] = groups[0]
    return fps[a].view(np.int64), fps[b].view(np.int64)


def near_links(prints: DataFrame, column: str = "simhash") -> DataFrame:
    """(a, b): links between distinct fingerprints that differ in at most 4 bits.

    They connect the same fingerprints as all such pairs do; within a dense group not every pair is
    listed. Null fingerprints link to none.
    """
    spark = prints.sparkSession
    distinct = materialize(prints.select(F.col(column).alias("fp")).dropna().distinct(), "fingerprints")
    total = distinct.count()
    picked = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    most = max(1, LEAF * len(picked) // max(total, 1))
    grown = [grow(np.unique(window(picked, k)), most) if len(picked) else (Node(leaf=0), 1) for k in range(len(WINDOWS))]
    trees = spark.sparkContext.broadcast([tree for tree, _ in grown])

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = batch.column(0).to_numpy().astype(np.int64)
            for k, tree in enumerate(trees.value):
                for leaf, rows, home in visit(tree, window(fps, k)):
                    if len(rows):
                        n = len(rows)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, leaf, np.int32)), pa.array(fps[rows]), pa.array(home)],
                            names=["tree", "leaf", "fp", "home"],
                        )

    with arrow_batches(spark, 10_000):
        placed = materialize(distinct.mapInArrow(place, "tree int, leaf int, fp long, home boolean"), "leaves")
    # at most as many rows as the trees have leaves, whatever the input
    size = placed.groupBy("tree", "leaf").agg(F.count(F.when(F.col("home"), 1)).alias("n_home"), F.count("*").alias("n"))
    size = size.select("tree", "leaf", F.ceil(F.col("n_home") / CHUNK).cast("int").alias("n_chunks"), F.ceil(F.col("n") / (4 * CHUNK)).cast("int").alias("n_parts"))
    spot = F.pmod(F.xxhash64("fp"), F.lit(1 << 30))
    met = (
        placed.join(F.broadcast(size), ["tree", "leaf"])
        .filter(F.col("n_chunks") > 0)
        # a home fingerprint is compared in its own chunk with each part of all that visit the leaf
        .withColumn("own", F.when(F.col("home"), F.pmod(spot, F.col("n_chunks")).cast("int")))
        .withColumn("part", F.pmod(spot, F.col("n_parts")).cast("int"))
        .withColumn("at", F.explode(_meetings()))
        .select("tree", "leaf", "fp", F.col("at.chunk").alias("chunk"), F.col("at.part").alias("part"), F.col("at.home").alias("home"))
    )

    def link(pdf):
        import pandas as pd

        pdf = pdf.groupby("fp", as_index=False)["home"].max()
        a, b = leaf_links(pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["home"].to_numpy(bool))
        return pd.DataFrame({"a": a, "b": b})

    return met.groupBy("tree", "leaf", "chunk", "part").applyInPandas(link, "a long, b long").distinct()


def _meetings():
    """Where a row of a leaf has to be: as a member with every part, as a visitor with every chunk."""
    chunks = F.transform(F.sequence(F.lit(0), F.col("n_chunks") - 1), lambda c: F.struct(c.alias("chunk"), F.col("part"), F.lit(False).alias("home")))
    parts = F.transform(F.sequence(F.lit(0), F.col("n_parts") - 1), lambda p: F.struct(F.col("own").alias("chunk"), p.alias("part"), F.lit(True).alias("home")))
    return F.when(F.col("home"), F.array_union(chunks, parts)).otherwise(chunks)


def groups(prints: DataFrame) -> DataFrame:
    """(simhash, root, component_id) of each fingerprint of `prints` (doc_id, simhash): its group's smallest fingerprint and doc_id."""
    links = materialize(near_links(prints), "near")
    roots = connected_components(links)
    # one row for each fingerprint, so the hot ones among the documents meet a single row
    named = prints.groupBy("simhash").agg(F.min("doc_id").alias("first")).join(roots, F.col("simhash") == F.col("node"), "left")
    named = materialize(named.select("simhash", "first", F.coalesce("root", "simhash").alias("root")), "named")
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(lowest, "root").select("simhash", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, simhash, component_id) of every row: the smallest doc_id that links of at most 4 bits reach.

    Rows with equal fingerprints are linked, texts without words too (fingerprint 0). A null doc_id
    never names a component unless all its ids are null. Every row comes back, repeated ones too.
    """
    prints = materialize(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"), "simhash")
    return prints.join(groups(prints).drop("root"), "simhash").select("doc_id", "simhash", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, ...) with one row of each group: that with the smallest doc_id, of equal ones the first text."""
    print_ = free_name(docs, "fingerprint")
    rows = with_fingerprints(docs, out=print_).select(F.struct(*docs.columns).alias("row"), F.col(print_).alias("simhash"))
    prints = materialize(with_fingerprints(docs.select("doc_id", "text")).drop("text"), "simhash")
    # only rows with the smallest id go on, so that a large group is no large window
    left = rows.join(groups(prints), "simhash").filter(F.col("row.doc_id").eqNullSafe(F.col("component_id")))
    order = Window.partitionBy("root").orderBy(F.col("row.text").asc_nulls_last())
    return left.withColumn("place", F.row_number().over(order)).filter("place = 1").select("row.*")
