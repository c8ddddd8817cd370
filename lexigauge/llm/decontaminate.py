"""Benchmark decontamination: short test items found inside documents of any length.

Texts are sets of shingles of 5 words (fewer words: the whole sequence, which then only a text of the
same few words shares). An item is contained in a document if the document has at least 0.8 of its
shingles. Items are partitioned by size into powers of two. Each partition has its own number k of
MinHash values, an item's k smallest under one random order of shingles: with k one more than the
shingles that may be missing, a document that contains an item holds at least one of them, so no
item is missed. A document is matched by holding such a value rather than by its own MinHash,
because the Jaccard similarity of a long document and a short item is near 0. Candidates must be
large enough for their partition and are verified on all shingles.

Rows of a table that share an id count as one text, null ids too. A null text is empty, and an empty
item or document has no shingles and matches nothing. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_within, materialize
from .common import constant_longs, let, normal_words, text_of

WORDS = 5
CONTAINED = 0.8
#: Bits of the filter that tells which shingles of a document any item may have; its size is fixed.
FILTER_BITS = 1 << 20
#: Rows up to which a table of items is broadcast (a few MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def with_shingles(df: DataFrame, *keep: Column, text: str = "text") -> DataFrame:
    """The `keep` columns and `shingles`: the hashes of all word shingles, repeats included."""
    words = F.filter(F.split(normal_words(text_of(df, text)), " "), lambda w: w != "")
    # one generated row, so that the words are cut once and not for each use
    rows = df.select(*keep, F.explode(F.array(words)).alias("_w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - WORDS, F.lit(0)))
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WORDS)]))
    kept = [c for c in rows.columns if c != "_w"]
    return rows.select(*kept, F.when(F.size("_w") > 0, hashed).otherwise(F.slice(hashed, 1, 0)).alias("shingles"))


def item_sketches(items: DataFrame, item_id: str = "item_id", contained: float = CONTAINED) -> DataFrame:
    """(item_id, shingles, n, need, sketch): each item's set, and its MinHash values.

    `need`: shingles a document must share. All items of a partition get the k of its largest.
    """
    sets = with_shingles(items, F.col(item_id).alias("item_id")).groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("shingles"))
    sized = sets.withColumn("n", F.size("shingles")).filter("n > 0")
    largest = 2 * F.pow(F.lit(2), F.floor(F.log2("n"))).cast("int") - 1
    k = F.floor(largest * F.lit(1 - contained) + F.lit(1e-9)).cast("int") + 1
    order = F.array_sort(F.transform("shingles", lambda s: F.struct(F.xxhash64(F.lit("order"), s).alias("o"), s.alias("s"))))
    sketch = F.transform(F.slice(order, F.lit(1), k), lambda x: x["s"])
    return sized.select("item_id", "shingles", "n", F.ceil(F.col("n") * F.lit(contained) - F.lit(1e-9)).cast("int").alias("need"), sketch.alias("sketch"))


def _filter_words(sketched: DataFrame) -> Column:
    """FILTER_BITS bits, one set for each item shingle, as an array of longs of fixed length."""
    bits = sketched.select(F.explode("shingles").alias("s")).select(F.pmod("s", F.lit(FILTER_BITS)).alias("bit")).groupBy(F.floor(F.col("bit") / 64).cast("int").alias("at"))
    words = bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("word"))
    return constant_longs(words.collect(), FILTER_BITS // 64)  # FILTER_BITS / 64 rows at most


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", contained: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, shared, n_shingles, containment) of every pair that reaches `contained`."""
    sketched = materialize(item_sketches(items, item_id, contained), "items")
    # texts are read once: only the shingles that an item may have go on
    rows = with_shingles(docs, F.col(doc_id).alias("doc_id"))

    def known(s: Column, words: Column) -> Column:
        word = F.get(words, F.shiftright(F.pmod(s, F.lit(FILTER_BITS)), 6).cast("int"))
        return F.bit_get(word, F.pmod(s, F.lit(64)).cast("int")) == 1

    kept = let(_filter_words(sketched), lambda words: F.array_distinct(F.filter("shingles", lambda s: known(s, words))))
    found = rows.select("doc_id", F.size("shingles").alias("size"), F.explode(F.array(kept)).alias("hits"))
    # at most one row for each document, and hardly more values than its items' shingles
    hits = found.filter(F.size("hits") > 0).groupBy("doc_id").agg(F.sum("size").alias("size"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"))
    hits = materialize(hits, "hits")
    values = sketched.select(F.explode("sketch").alias("s"), "item_id", "need")
    met = hits.select("doc_id", "size", F.explode("hits").alias("s")).join(broadcast_within(values, BROADCAST_ROWS), "s")
    candidates = met.filter(F.col("size") >= F.col("need")).select("doc_id", "item_id").distinct()
    sets = broadcast_within(sketched.select("item_id", "shingles", "n", "need"), BROADCAST_ROWS // 100)
    pairs = candidates.join(hits.select("doc_id", "hits"), candidates["doc_id"].eqNullSafe(hits["doc_id"])).select(candidates["doc_id"], "item_id", "hits")
    checked = pairs.join(sets, pairs["item_id"].eqNullSafe(sets["item_id"])).select(
        "doc_id", pairs["item_id"], F.size(F.array_intersect("hits", "shingles")).alias("shared"), F.col("n").alias("n_shingles"), "need"
    )
    return checked.filter("shared >= need").select("doc_id", "item_id", "shared", "n_shingles", (F.col("shared") / F.col("n_shingles")).alias("containment"))
