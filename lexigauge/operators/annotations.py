"""Counts over annotated tokens.

Input: `tokens(doc_id, dataset_name, sent_id, tok_id, form, upos, head, deprel, ent_type,
ent_iob)`, as written by whatever tagger the user owns. `tok_id` and `head` share one index
per document, and a root is its own head.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pos_counts(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """`(keys, upos, n)`, over all tokens."""
    return tokens.groupBy(*keys, "upos").agg(F.count("*").alias("n"))


def entity_counts(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """`(keys, ent_type, n)`: entity spans, counted at their first token."""
    begins = tokens.filter(F.col("ent_iob") == "B")
    return begins.groupBy(*keys, "ent_type").agg(F.count("*").alias("n"))


def dependency_counts(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """`(keys, deprel, n)`."""
    return tokens.groupBy(*keys, "deprel").agg(F.count("*").alias("n"))


def max_arc_length(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """`(keys, avg_max_arc_length)`: mean over sentences of their longest head distance.

    Sentences of one token do not count; 0 if a key has no longer sentence. Tokens of a
    sentence lie together, so partial aggregation leaves about one row per sentence.
    """
    sentence = list(dict.fromkeys([*keys, "doc_id", "sent_id"]))
    arcs = tokens.groupBy(*sentence).agg(
        F.count("*").alias("size"), F.max(F.abs(F.col("tok_id") - F.col("head"))).alias("arc")
    )
    longest = F.avg(F.when(F.col("size") > 1, F.col("arc")))
    return arcs.groupBy(*keys).agg(F.coalesce(longest, F.lit(0.0)).alias("avg_max_arc_length"))


_LABELS = {"pos": "pos", "ner": "ner", "dep": "dependency_stats"}


def token_profile(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """`(keys, pos, ner, dependency_stats, avg_max_arc_length)`: label counts as maps and the mean longest arc, in one scan.

    Every token gives a row for each of its labels and one for its sentence; all are counted by (key, kind, label,
    sentence) before anything is collected, so the maps are as large as the tag sets, whatever the number of tokens.
    """
    no_label, no_arc = F.lit(None).cast("string"), F.lit(None).cast("int")
    # a label is counted over all documents of a key, so its rows have no sentence
    place = {c: F.lit(None).cast(tokens.schema[c].dataType) for c in ("doc_id", "sent_id")}

    def row(kind: str, label, doc_id, sent_id, arc):
        return F.struct(F.lit(kind).alias("kind"), label.alias("label"), doc_id.alias("in_doc"), sent_id.alias("in_sent"), arc.cast("int").alias("arc"))

    rows = F.array(
        row("pos", F.col("upos"), place["doc_id"], place["sent_id"], no_arc),
        row("ner", F.when(F.col("ent_iob") == "B", F.col("ent_type")), place["doc_id"], place["sent_id"], no_arc),
        row("dep", F.col("deprel"), place["doc_id"], place["sent_id"], no_arc),
        row("arc", no_label, F.col("doc_id"), F.col("sent_id"), F.abs(F.col("tok_id") - F.col("head"))),
    )
    counts = (
        tokens.select(*keys, F.inline(rows))
        .groupBy(*keys, "kind", "label", "in_doc", "in_sent")
        .agg(F.count("*").alias("n"), F.max("arc").alias("arc"))
    )
    entry = F.struct("label", "n")

    def as_map(kind: str):
        usable = (F.col("kind") == kind) & F.col("label").isNotNull()
        return F.map_from_entries(F.collect_list(F.when(usable, entry)))

    longest = F.avg(F.when((F.col("kind") == "arc") & (F.col("n") > 1), F.col("arc")))
    return counts.groupBy(*keys).agg(
        *[as_map(kind).alias(name) for kind, name in _LABELS.items()],
        F.coalesce(longest, F.lit(0.0)).alias("avg_max_arc_length"),
    )
