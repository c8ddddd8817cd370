"""Ranks over a whole table without putting it into one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigauge.session import materialize


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """`df` with the place of every row in `order`, from 1.

    Ranges of the order are sorted each on its own and written; a row's rank is its place in its
    range plus the rows of the ranges before, of which one number each goes through the driver.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    # the upper bits of such an id are the partition, the lower 33 the row in it
    part, row = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = kept.groupBy(part.alias("part")).count().orderBy("part").collect()
    starts = dict(zip((r.part for r in sizes), accumulate((r["count"] for r in sizes), initial=0)))
    if len(starts) <= 1:
        start = F.lit(0)
    else:
        start = F.try_element_at(F.create_map(*[F.lit(v) for pair in starts.items() for v in pair]), part)
    return kept.withColumn(name, (row + start + 1).cast("int")).drop("_at")
