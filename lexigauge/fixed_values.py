"""Names, lists and coefficients the results must agree on."""

# --- Fixed values: characters counted as whitespace (the Unicode whitespace set) ---
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a regex character class (valid in Java and RE2).
WS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# Again the same set, in the form Java's regex engine tests fastest: everything below U+1680
# is settled by two checks.
JAVA_WS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)

# --- Fixed values: text patterns ---
WORD = r"[\p{L}\p{N}]+"
LONG_WORD = 7  # the LIX definition: more than six characters
# A sentence starts at its first letter or digit and ends after its terminators.
SENTENCE = rf"[\p{{L}}\p{{N}}](?:[^.!?]*[^.!?{WS}])?[.!?]*"
LATIN_VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ"
CYRILLIC_VOWELS = "аеёиоуыэюя"
VOWELS = LATIN_VOWELS + LATIN_VOWELS.upper() + CYRILLIC_VOWELS + CYRILLIC_VOWELS.upper()

# --- Fixed values: languages with rules of their own; all others share "other" ---
COMPLEX_WORD_SYLLABLES = {"ru": 4, "other": 3}

# --- Fixed values: readability coefficients, per language and metric ---
# "other": Flesch 1948, Gunning 1952, McLaughlin 1969, Smith & Senter 1967,
# Coleman & Liau 1975, Kincaid 1975, Björnsson 1968.
# "ru": reading ease after Oborneva 2006; grade, SMOG, ARI and Coleman-Liau after the
# public "Plain Russian" adaptation (Begtin 2014). The Russian set is unverified.
READABILITY = {
    "flesch_reading_easy": {
        "other": {"base": 206.835, "words_per_sent": -1.015, "syllables_per_word": -84.6},
        "ru": {"base": 206.835, "words_per_sent": -1.3, "syllables_per_word": -60.1},
    },
    "gunning_fog": {
        "other": {"base": 0.0, "words_per_sent": 0.4, "complex_per_word": 40.0},
        "ru": {"base": 0.0, "words_per_sent": 0.4, "complex_per_word": 40.0},
    },
    "automated_readability_index": {
        "other": {"base": -21.43, "words_per_sent": 0.5, "letters_per_word": 4.71},
        "ru": {"base": -31.04, "words_per_sent": 0.2805, "letters_per_word": 6.26},
    },
    "coleman_liau_index": {
        "other": {"base": -15.8, "letters_per_word": 5.88, "sents_per_word": -29.6},
        "ru": {"base": -20.33, "letters_per_word": 5.5, "sents_per_word": -35.0},
    },
    "flesch_kincaid_grade": {
        "other": {"base": -15.59, "words_per_sent": 0.39, "syllables_per_word": 11.8},
        "ru": {"base": -16.59, "words_per_sent": 0.49, "syllables_per_word": 7.3},
    },
    "lix": {
        "other": {"base": 0.0, "words_per_sent": 1.0, "long_per_word": 100.0},
        "ru": {"base": 0.0, "words_per_sent": 1.0, "long_per_word": 100.0},
    },
}
# SMOG: factor * sqrt(scale * complex / sentences) + base, 0 below three sentences.
SMOG = {
    "other": {"factor": 1.043, "scale": 30.0, "base": 3.1291},
    "ru": {"factor": 1.1, "scale": 64.6, "base": 0.05},
}
READABILITY_METRICS = [
    "flesch_reading_easy",
    "gunning_fog",
    "smog_index",
    "automated_readability_index",
    "coleman_liau_index",
    "flesch_kincaid_grade",
    "lix",
]

# --- Fixed values: the count columns of a text profile ---
SUMMED_COUNTS = [
    "n_chars",
    "n_complex_words",
    "n_letters",
    "n_long_words",
    "n_monosyllable_words",
    "n_polysyllable_words",
    "n_punctuations",
    "n_sents",
    "n_simple_words",
    "n_spaces",
    "n_syllables",
    "n_word_chars",
    "n_words",
]

# --- Fixed values: label sets of the 86-column feature row ---
DEPENDENCY_RELATIONS = [
    "ROOT", "acl", "acl:relcl", "advcl", "advmod", "amod", "appos", "aux", "aux:pass",
    "case", "cc", "ccomp", "compound", "conj", "cop", "csubj", "csubj:pass", "dep", "det",
    "discourse", "expl", "fixed", "flat", "flat:foreign", "flat:name", "iobj", "list",
    "mark", "nmod", "nsubj", "nsubj:pass", "nummod", "nummod:entity", "nummod:gov", "obj",
    "obl", "obl:agent", "orphan", "parataxis", "punct", "xcomp",
]
ENTITY_LABELS = ["LOC", "ORG", "PER"]
POS_TAGS = [
    "ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON",
    "PROPN", "PUNCT", "SCONJ", "SPACE", "SYM", "VERB", "X",
]
BASIC_BY_WORDS = [
    "n_chars", "n_complex_words", "n_letters", "n_long_words", "n_monosyllable_words",
    "n_polysyllable_words", "n_punctuations", "n_simple_words", "n_spaces", "n_syllables",
    "n_unique_words",
]

# --- Fixed values: column names of the 86-column feature row, in order ---
UNNAMED = "unnamed_dataset"
N_SENTS = "basic_statistics_n_sents"
N_WORDS = "basic_statistics_n_words"
BY_SENTENCES = [f"dependency_{r}" for r in DEPENDENCY_RELATIONS]
BY_WORDS = (
    [f"pos_ner_analysis_ner_{e}" for e in ENTITY_LABELS]
    + [f"pos_ner_analysis_pos_{t}" for t in POS_TAGS]
    + [f"basic_statistics_{c}" for c in BASIC_BY_WORDS]
)
OTHER_FEATURES = [
    "readability_statistics_automated_readability_index",
    "readability_statistics_coleman_liau_index",
    "readability_statistics_flesch_kincaid_grade",
    "readability_statistics_flesch_reading_easy",
    "readability_statistics_lix",
    "readability_statistics_smog_index",
    "sentiment_analysis_polarity",
    "sentiment_analysis_subjectivity",
    "syntactic_analysis_avg_tree_depth",
    "text_homogeneity_avg_similarity",
]
FEATURE_COLUMNS = [N_SENTS, N_WORDS] + BY_SENTENCES + BY_WORDS + OTHER_FEATURES
TEMPLATE_COLUMNS = ["dataset_name"] + FEATURE_COLUMNS

# --- Fixed values: comparison constants ---
STD_GUARD = 1e-10  # added to a standard deviation before dividing by it

# Headings and line formats of the reports.
GROUP_HEADING = "Top Statistical Matches"
GROUP_LINE = "%s: %.1f%%"
DIFFERENCES_HEADING = "Key Differences vs "
DIFFERENCE_LINE = "%s: User=%.2f, Group=%.2f (Z=%.2f)"
OVERALL_HEADING = "Overall Statistical Comparison"
MASTER_MEANS = "Master Data Means: "
USER_MEANS = "User Data Means: "
MEAN_ENTRY = "%s=%.2f"
DIVERGENT_HEADING = "Most Divergent Features"
DIVERGENT_LINE = "%s: User=%.2f vs Master=%.2f±%.2f (Z=%.2f, Similarity=%.1f%%)"
