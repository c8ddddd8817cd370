"""The full profile of a corpus, from texts and annotated tokens to feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigauge.fixed_values import (
    BASIC_BY_WORDS,
    DEPENDENCY_RELATIONS,
    ENTITY_LABELS,
    POS_TAGS,
    READABILITY_METRICS,
)
from lexigauge.operators.annotations import token_profile
from lexigauge.operators.features import flatten, template_view
from lexigauge.operators.text_profile import profile_datasets, profile_documents

MAP_KEYS = {
    "pos_ner_analysis_pos": POS_TAGS,
    "pos_ner_analysis_ner": ENTITY_LABELS,
    "syntactic_analysis_dependency_stats": DEPENDENCY_RELATIONS,
}


def full_profile(
    docs: DataFrame, tokens: DataFrame, grain: str = "dataset", lang: str | None = None
) -> DataFrame:
    """One row per dataset or document with the five results as nested columns.

    `docs(doc_id, dataset_name, text[, lang])` and `tokens` as in `operators.annotations`.
    Texts are reduced to counts before the join, so only counts are shuffled. A key without
    tokens keeps empty maps; `text_homogeneity` is null below two sentences.
    """
    if grain == "dataset":
        keys = ["dataset_name"]
        profile = profile_datasets(docs, "dataset_name", lang=lang)
    elif grain == "document":
        keys = ["doc_id"]
        profile = profile_documents(docs, ["doc_id", "dataset_name"], lang=lang)
    else:
        raise ValueError("grain must be 'dataset' or 'document'")
    joined = profile.join(token_profile(tokens, keys), keys, "left")
    names = [c for c in ("doc_id", "dataset_name") if c in joined.columns]
    empty = F.create_map().cast("map<string,bigint>")
    arc = F.coalesce(F.col("avg_max_arc_length"), F.lit(0.0))
    return joined.select(
        *names,
        F.struct("n_sents", "n_words", "avg_word_length", *BASIC_BY_WORDS).alias("basic_statistics"),
        F.struct(*READABILITY_METRICS).alias("readability_statistics"),
        F.struct(
            F.coalesce("pos", empty).alias("pos"), F.coalesce("ner", empty).alias("ner")
        ).alias("pos_ner_analysis"),
        F.struct(
            F.coalesce("dependency_stats", empty).alias("dependency_stats"),
            arc.alias("avg_max_arc_length"),
            arc.alias("avg_tree_depth"),
        ).alias("syntactic_analysis"),
        F.when(
            F.col("avg_similarity").isNotNull(), F.struct(F.col("avg_similarity"))
        ).alias("text_homogeneity"),
    )


def flat_profile(profile: DataFrame) -> DataFrame:
    """The profile with one column per value and known label."""
    return flatten(profile, MAP_KEYS)


def dataset_features(docs: DataFrame, tokens: DataFrame, lang: str | None = None) -> DataFrame:
    """The 86-column feature row of every dataset."""
    return template_view(flat_profile(full_profile(docs, tokens, "dataset", lang)))
