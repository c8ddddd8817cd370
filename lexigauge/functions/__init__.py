"""Column functions: each takes and returns ``Column`` objects, nothing runs here."""

from lexigauge.functions.cleaning import clean_text, is_valid_text
from lexigauge.functions.homogeneity import adjacent_similarities, multiset_cosine
from lexigauge.functions.readability import readability_columns
from lexigauge.functions.text import analysis_language, sentences, words

__all__ = [
    "adjacent_similarities",
    "analysis_language",
    "clean_text",
    "is_valid_text",
    "multiset_cosine",
    "readability_columns",
    "sentences",
    "words",
]
