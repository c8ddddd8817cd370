"""Merkle manifest of a dataset by time-forward processing: digests up to the root, proof suffixes down to the leaves.

A leaf is the SHA-256 of a row's fields; FAN consecutive nodes of a source become one node above them until one is
left, the subroot; subroots in the order of their sources become the root likewise. Every node has a label (tree,
place). A node's message to its parent goes through a queue that holds all messages in the order of the labels of
their receivers: Spark's external sort by ranges of labels. One step of the sweep takes the messages of one height out of
it, 1/FAN as many as the step before, and puts those of the next height in. The reversed sweep starts at the root and
hands each parent's proof suffix (the texts left and right of the path, height by height) to its children. Leaves
stay in their runs of FAN, so that a suffix travels once a run.

No source is gathered in one task: places are counted by ranges of (source, doc_id), with the counts of the ranges
before added. A row of a run holds FAN leaves, a proof FAN - 1 digests a height.

Null fields are `-`, empty texts `0:`. A null source is a source of its own, before all others. Rows of equal
source and doc_id follow their digests, so repeated rows have equal digests and proofs of their own; null ids come
first. A text of any length is one field. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of texts put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the bytes of the value as text, `:`, and that text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, altered: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, source, digest, shown): the leaf of each row, and that of the row with the columns of `altered` in place."""
    altered = altered or {}
    return docs.select(
        "doc_id", "source",
        digest(*(encoded(F.col(f)) for f in fields)).alias("digest"),
        digest(*(encoded(altered.get(f, F.col(f))) for f in fields)).alias("shown"),
    )


def placed(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """`rows` with `idx`, the place of each among the rows of its tree (from 0), and `n`, how many these are.

    Ranges of (tree, order) are sorted each on its own; a range's places follow those of the ranges before.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("part", F.shiftright("at", 33)), name)
    # one row for each range and each tree in it
    ranges = dealt.groupBy(tree, "part").agg(F.min("at").alias("start"), F.count("*").alias("rows"))
    of_tree = Window.partitionBy(tree)
    before = F.sum("rows").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(tree, "part", (F.coalesce(before, F.lit(0)) - F.col("start")).alias("shift"), F.sum("rows").over(of_tree).alias("n"))
    return dealt.join(ranges, [tree, "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def runs(nodes: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """(tree, idx, n, members, digest): each parent with the messages of its children, in their order.

    A tree of one node has no parent: its run is that node and keeps the node's digest.
    """
    message = F.struct(F.col("idx").alias("at"), "digest", *payload)
    queue = nodes.select("tree", F.expr(f"idx div {FAN}").alias("idx"), "n", message.alias("message"))
    queue = queue.repartitionByRange("tree", "idx").sortWithinPartitions("tree", "idx")
    taken = queue.groupBy("tree", "idx").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("message")).alias("members"))
    joined = digest(F.array_join("members.digest", ""))
    return taken.withColumn("digest", F.when(F.col("n") == 1, F.col("members")[0]["digest"]).otherwise(joined))


def climb(nodes: DataFrame, name: str, payload: tuple[str, ...] = ()) -> list[DataFrame]:
    """The runs of each height, from the bottom, until one node is left of every tree."""
    heights, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        heights.append(materialize(runs(nodes, payload), f"{name}{len(heights) + 1}"))
        most, payload = -(-most // FAN), ()
        if most <= 1:
            return heights
        nodes = heights[-1].select("tree", "idx", "digest", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n")).filter("n > 1")


def sides(members: Column, i: Column) -> Column:
    """struct(left, right): the digests before and behind place i of a run, joined."""
    hashes = members["digest"]
    # arrays count from 1
    return F.struct(
        F.array_join(F.slice(hashes, F.lit(1), i), "").alias("left"),
        F.array_join(F.slice(hashes, i + 2, F.lit(FAN)), "").alias("right"),
    )


def descend(heights: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """The runs of the lowest height with `path`, `subroot`, `root` of their parents: the reversed sweep.

    tops: (tree, path, subroot, root) of each tree's last node.
    """
    known = None
    for k in range(len(heights) - 1, -1, -1):
        ends = heights[k].filter(F.col("n") <= FAN).select("tree", "idx").join(tops, "tree")
        known = ends if known is None else known.unionByName(ends)
        met = heights[k].drop("digest").join(known, ["tree", "idx"])
        if k == 0:
            return met
        child = F.explode(
            F.transform("members", lambda m, i: F.struct(m["at"].alias("idx"), F.concat(F.array(sides(F.col("members"), i)), F.col("path")).alias("path")))
        ).alias("child")
        known = materialize(met.select("tree", child, "subroot", "root").select("tree", "child.idx", "child.path", "subroot", "root"), f"{name}{k}")


def manifest(docs: DataFrame, altered: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof_sha256, shown_leaf, folded_root, verified) of every row.

    proof_sha256 digests the siblings on the way to the root; folded_root is what they and the altered row's leaf
    give; verified tells whether that is the root.
    """
    rows = materialize(leaves(docs, altered, fields).withColumn("tree", encoded(F.col("source"))), "leaves")
    rows = placed(rows, "tree", ["source", "doc_id", "digest", "shown"], "placed")
    heights = climb(rows, "runs", payload=("doc_id", "source", "shown"))
    subroots = heights[0].filter(F.col("n") <= FAN).select("tree", "digest", F.col("members")[0]["source"].alias("source"))
    for runs_above in heights[1:]:
        higher = runs_above.filter(F.col("n") <= FAN).select("tree", "digest")
        # the source stands in the leaves only; a tree's first run has it
        named = heights[0].filter("idx = 0").select("tree", F.col("members")[0]["source"].alias("source"))
        subroots = subroots.unionByName(higher.join(named, "tree"))
    crown = subroots.select(F.lit("").alias("crown"), "tree", "digest", "source")
    crown = placed(crown, "crown", ["source"], "subroots").select(F.col("crown").alias("tree"), "idx", "n", "digest", F.col("tree").alias("below"))
    above = climb(crown, "crown", payload=("below",))
    last = above[-1].filter(F.col("n") <= FAN)
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    root = last.select("tree", no_path.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    ways = descend(above, root, "crown_paths")
    own = F.when(F.col("n") == 1, F.col("path"))
    way = F.explode(
        F.transform(
            "members",
            lambda m, i: F.struct(
                m["below"].alias("tree"), m["digest"].alias("subroot"),
                F.coalesce(own, F.concat(F.array(sides(F.col("members"), i)), F.col("path"))).alias("path"),
            ),
        )
    ).alias("way")
    tops = materialize(ways.select(way, "root").select("way.tree", "way.path", "way.subroot", "root"), "tops")
    return _proved(descend(heights, tops, "paths"))


def _proved(met: DataFrame) -> DataFrame:
    """The rows of each run: its parent's proof suffix is put behind each leaf's own siblings."""
    suffix = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    met = met.withColumn("suffix", suffix)

    def proved(m: Column, i: Column) -> Column:
        side = sides(F.col("members"), i)
        first = F.when(F.col("n") == 1, m["shown"]).otherwise(digest(side["left"], m["shown"], side["right"]))
        return F.struct(
            m["doc_id"].alias("doc_id"), m["source"].alias("source"), m["digest"].alias("leaf"),
            digest(side["left"], side["right"], F.col("suffix")).alias("proof_sha256"), m["shown"].alias("shown_leaf"),
            F.aggregate("path", first, lambda node, s: digest(s["left"], node, s["right"])).alias("folded_root"),
        )

    out = met.select(F.explode(F.transform("members", proved)).alias("r"), "subroot", "root").select("r.*", "subroot", "root")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
