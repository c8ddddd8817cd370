"""Profiles whose language rules follow from the language found in each text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigauge.fixed_values import READABILITY_METRICS, SUMMED_COUNTS
from lexigauge.functions import text as X
from lexigauge.operators import text_profile as T
from lexigauge.operators.language import detect_language

#: The counts that Russian texts have rules of their own for.
ROUTED = ["n_syllables", "n_monosyllable_words", "n_polysyllable_words", "n_complex_words", "n_simple_words"]


def _counts_by_both_rules(docs: DataFrame, text: str) -> DataFrame:
    """All counts by the general rules, and `_ru`, the routed ones by the Russian rules; row-wise."""
    counted = T.split_and_counted(docs, text).withColumn("_units", X.vowel_units(F.col("_joined"), F.lit("ru")))
    found = {f"_{c}": e for c, e in X.syllable_counts(F.col("_units"), F.lit("ru")).items()}
    counted = counted.withColumns(found)
    derived = X.syllable_results(
        F.col("n_words"),
        F.col("_n_vowel_units"),
        F.col("_n_words_with_vowel"),
        F.col("_n_polysyllable_words"),
        F.col("_n_complex_words"),
    )
    derived |= {"n_polysyllable_words": F.col("_n_polysyllable_words"), "n_complex_words": F.col("_n_complex_words")}
    return counted.withColumn("_ru", F.struct(*[derived[c].alias(c) for c in ROUTED]))


def profile_detected(
    docs: DataFrame, languages: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), words: DataFrame | None = None
) -> DataFrame:
    """The profile of every document, by the rules of the language detected in it.

    languages: the table of `operators.language.fit_profile`, words: that of `word_weights`. Texts
    are reduced to numbers by both sets of rules where they are read, and one of the two is taken when
    the language is known: no text is shuffled to meet its language. `key` names each
    document once. A text without a known n-gram has null languages and the general rules.
    """
    found = detect_language(docs, languages, key, text, words)
    numbers = list(dict.fromkeys([*SUMMED_COUNTS, "n_unique_words", "n_pairs", "sum_similarity", "avg_similarity"]))
    counts = _counts_by_both_rules(docs, text).select(key, *carry, *numbers, "_ru")
    joined = counts.join(found, key, "left")
    is_russian = F.col("analysis_lang") == "ru"
    routed = {c: F.when(is_russian, F.col("_ru")[c]).otherwise(F.col(c)) for c in ROUTED}
    routed["avg_word_length"] = X.mean_word_length(F.col("n_word_chars"), F.col("n_words"))
    scored = T.readability(joined.withColumns(routed), "analysis_lang")
    return scored.select(
        key, *carry, "detected_lang", "analysis_lang", *SUMMED_COUNTS, "n_unique_words", "avg_word_length",
        *READABILITY_METRICS, "n_pairs", "sum_similarity", "avg_similarity",
    )


def profile_detected_datasets(
    docs: DataFrame, languages: DataFrame, name: str = "dataset_name", key: str = "doc_id", text: str = "text", words: DataFrame | None = None
) -> DataFrame:
    """The same per dataset: counts add up, each by its document's rules; Russian coefficients where most words are Russian.

    Distinct words do not depend on the language and are counted on their own.
    """
    rows = profile_detected(docs, languages, key, text, (name,), words)
    rows = rows.withColumn("ru_words", F.when(F.col("analysis_lang") == "ru", F.col("n_words")))
    sums = [*SUMMED_COUNTS, "n_pairs", "sum_similarity", "ru_words"]
    summed = rows.groupBy(name).agg(F.count("*").alias("n_docs"), *[F.sum(c).alias(c) for c in sums])
    vocabulary = T.unique_words_by(docs, name, text).withColumnRenamed(name, "_name")
    totals = summed.join(vocabulary, F.col(name).eqNullSafe(F.col("_name"))).drop("_name")
    return T.finish_datasets(totals, name)
