"""Readability metrics as arithmetic on counts; NULL where a denominator is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigauge.fixed_values import READABILITY, READABILITY_METRICS, SMOG


def _coefficient(lang: Column | None, sets: dict[str, dict[str, float]], name: str) -> Column:
    ru, other = F.lit(sets["ru"][name]), F.lit(sets["other"][name])
    return other if lang is None else F.when(lang == "ru", ru).otherwise(other)


def readability_columns(count, lang: Column | None = None) -> dict[str, Column]:
    """All metrics; `count` maps a count's name to its Column (such as `F.col`)."""
    n_words, n_sents = count("n_words"), count("n_sents")
    ratios = {
        "words_per_sent": F.try_divide(n_words, n_sents),
        "syllables_per_word": F.try_divide(count("n_syllables"), n_words),
        "complex_per_word": F.try_divide(count("n_complex_words"), n_words),
        "letters_per_word": F.try_divide(count("n_letters"), n_words),
        "sents_per_word": F.try_divide(n_sents, n_words),
        "long_per_word": F.try_divide(count("n_long_words"), n_words),
    }
    out = {}
    for metric, sets in READABILITY.items():
        value = _coefficient(lang, sets, "base")
        for term in sets["other"]:
            if term != "base":
                value = value + _coefficient(lang, sets, term) * ratios[term]
        out[metric] = value
    complex_per_sent = F.try_divide(count("n_complex_words"), n_sents)
    out["smog_index"] = F.when(n_sents < 3, F.lit(0.0)).otherwise(
        _coefficient(lang, SMOG, "factor")
        * F.sqrt(_coefficient(lang, SMOG, "scale") * complex_per_sent)
        + _coefficient(lang, SMOG, "base")
    )
    return {metric: out[metric] for metric in READABILITY_METRICS}
