"""Connected components by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that can be reached from each node of `links`.

    Every round takes the smallest root among a node's neighbours, then the root of that root, so
    the rounds grow with the logarithm of a component's width. Rounds are written to the shared
    folder: an executor may be lost at any time. Links of a node to itself and repeated links do no
    harm; a null end is no node and its link is left out.
    """
    one = links.select(F.col(a).alias("node"), F.col(b).alias("near")).dropna()
    both = materialize(one.union(one.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct(), "links")
    roots = materialize(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root")), "roots")
    while True:
        near = both.join(roots.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("root").alias("other"))
        best = roots.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "other").alias("root"))
        top = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = best.join(top, "root").select("node", "was", F.least("root", "above").alias("root"))
        done = materialize(jumped, "roots")
        roots = done.select("node", "root")
        if done.filter(F.col("was") != F.col("root")).isEmpty():
            return roots
