"""Words, sentences and counts of a text, from built-in regex functions only.

Words are put together once with plain blanks between them, and counts are sizes of what patterns leave, for
replacing takes a third of the time of collecting matches; no pattern can rescan a
long run from each of its characters, so the cost stays linear on junk text too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigauge.fixed_values import (
    COMPLEX_WORD_SYLLABLES,
    JAVA_WS,
    LONG_WORD,
    SENTENCE,
    VOWELS,
    WORD,
)

# Java tests the members of a class above U+00FF one by one; behind a range check they cost
# nothing on Latin text.
_VOWELS = "{}[\\x{{100}}-\\x{{4ff}}&&[{}]]".format(
    "".join(v for v in VOWELS if v <= "\xff"), "".join(v for v in VOWELS if v > "\xff")
)
_VOWEL = f"[{_VOWELS}]"
#: Stands for a vowel unit or a long word; no letter, digit or blank.
_MARK = "\x01"


def _by_language(lang: Column | None, russian: Column, other: Column) -> Column:
    return other if lang is None else F.when(lang == "ru", russian).otherwise(other)


def _chars_in(text: Column, char_class: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"{char_class}+", ""))).cast("bigint")


def words(text: Column) -> Column:
    """Array of words: runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def sentences(text: Column) -> Column:
    """Array of sentences: runs without terminators that hold a letter or digit, plus `.!?`."""
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def analysis_language(lang: Column) -> Column:
    """Russian rules for `ru`, the general rules for everything else."""
    return F.when(lang == "ru", F.lit("ru")).otherwise(F.lit("en"))


def unique_words(text: Column) -> Column:
    """Distinct lower-cased words of one text, null for none."""
    return unique_of_joined(joined_words(text))


def unique_of_joined(joined: Column) -> Column:
    return F.array_distinct(list_of_joined(F.lower(joined)))


def count_words(joined: Column) -> Column:
    blanks = F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(" "), F.lit("")))
    return F.when(joined == " ", 0).otherwise(blanks).cast("bigint")


def basic_counts(text: Column, joined: Column, sents: Column) -> dict[str, Column]:
    n_words = count_words(joined)
    return {
        "n_chars": F.length(text).cast("bigint"),
        "n_words": n_words,
        "n_sents": F.size(sents).cast("bigint"),
        # without the blanks before the words
        "n_word_chars": F.length(F.trim(joined)) - F.greatest(n_words - 1, F.lit(0)),
    }


def char_class_counts(text: Column) -> dict[str, Column]:
    return {
        "n_letters": _chars_in(text, r"\p{L}"),
        "n_spaces": _chars_in(text, f"[{JAVA_WS}]"),
        "n_punctuations": _chars_in(text, r"\p{P}"),
    }


def long_words(joined: Column) -> dict[str, Column]:
    return {"n_long_words": _marks(F.regexp_replace(joined, f"[^ ]{{{LONG_WORD},}}", _MARK))}


def joined_words(text: Column) -> Column:
    """The words of a text with one blank before and between them; of a text without words a blank or nothing."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def list_of_joined(joined: Column) -> Column:
    """The words that `joined_words` put together, as an array."""
    return F.array_remove(F.split(joined, " "), "")


def _marks(marked: Column, before: str = "", times: int = 1) -> Column:
    """How often marks stand in a text, or runs of at least `times` after a blank."""
    found = before + _MARK * times
    gone = F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit(found), F.lit("")))
    return F.call_function("div", gone, F.lit(len(found))).cast("bigint")


def vowel_units(joined: Column, lang: Column | None = None) -> Column:
    """A mark for each vowel group (Russian: vowel) of the words put together by `joined_words`, and the blanks."""
    marked = _by_language(lang, F.regexp_replace(joined, _VOWEL, _MARK), F.regexp_replace(joined, f"{_VOWEL}+", _MARK))
    return F.regexp_replace(marked, f"[^{_MARK} ]+", "")


def syllable_counts(units: Column, lang: Column | None = None) -> dict[str, Column]:
    """Vowel counts a word's syllables are built from; `units` as of `vowel_units`.

    A word has as many syllables as vowel groups (Russian: vowels), and at least one.
    """
    ru, other = COMPLEX_WORD_SYLLABLES["ru"], COMPLEX_WORD_SYLLABLES["other"]
    return {
        "n_vowel_units": _marks(units),
        "n_words_with_vowel": _marks(units, " "),
        "n_polysyllable_words": _marks(units, " ", 2),
        "n_complex_words": _by_language(lang, _marks(units, " ", ru), _marks(units, " ", other)),
    }


def syllable_results(
    n_words: Column, vowel_units: Column, with_vowel: Column, poly: Column, complex_: Column
) -> dict[str, Column]:
    """Counts that follow from `syllable_counts` by subtraction."""
    return {
        "n_syllables": vowel_units + n_words - with_vowel,
        "n_monosyllable_words": n_words - poly,
        "n_simple_words": n_words - complex_,
    }


def mean_word_length(n_word_chars: Column, n_words: Column) -> Column:
    return F.coalesce(F.try_divide(n_word_chars, n_words), F.lit(0.0))
