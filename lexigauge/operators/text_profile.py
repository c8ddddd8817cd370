"""Counts, readability and homogeneity of texts, per document or per dataset.

Document-grain operators are row-wise: no shuffle, and they also run on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigauge.fixed_values import READABILITY_METRICS, SUMMED_COUNTS
from lexigauge.functions import chunks as C
from lexigauge.functions import text as X
from lexigauge.functions.homogeneity import adjacent_similarities, adjacent_similarities_in_batches
from lexigauge.functions.readability import readability_columns


#: Bits of a sketch's registers: 4096 of them, a relative error of 1.6 % as a rule.
SKETCH_PRECISION = 12


def _lang(lang: str | None):
    return None if lang is None else F.col(lang)


def _add(df: DataFrame, columns: dict) -> DataFrame:
    return df.withColumns(columns) if columns else df


def _fill_text(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")))


#: What `_split` adds: a text's words put together, its sentences.
_SPLIT = ["_joined", "_sents"]


def _split(df: DataFrame, text: str) -> DataFrame:
    """The parts that counts are taken from, each made by one pass over the text, and only if something asks for it."""
    return _fill_text(df, text).withColumns({"_joined": X.joined_words(F.col(text)), "_sents": X.sentences(F.col(text))})


def _basic(df: DataFrame, text: str) -> DataFrame:
    return _add(df, X.basic_counts(F.col(text), F.col("_joined"), F.col("_sents")))


def _syllables(df: DataFrame, lang: Column | None) -> DataFrame:
    """Vowel counts of the joined words; `_finish_syllables` makes syllables of them."""
    df = df.withColumn("_units", X.vowel_units(F.col("_joined"), lang))
    return _add(df, X.syllable_counts(F.col("_units"), lang)).drop("_units")


def basic_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_chars, n_words, n_sents, n_word_chars and avg_word_length."""
    df = _basic(_split(df, text), text).drop(*_SPLIT)
    return df.withColumn(
        "avg_word_length", X.mean_word_length(F.col("n_word_chars"), F.col("n_words"))
    )


def char_classes(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_letters, n_spaces and n_punctuations."""
    return _add(_fill_text(df, text), X.char_class_counts(F.col(text)))


def _finish_syllables(df: DataFrame) -> DataFrame:
    derived = X.syllable_results(
        F.col("n_words"),
        F.col("n_vowel_units"),
        F.col("n_words_with_vowel"),
        F.col("n_polysyllable_words"),
        F.col("n_complex_words"),
    )
    return df.withColumns(derived).drop("n_vowel_units", "n_words_with_vowel")


def syllable_stats(df: DataFrame, text: str = "text", lang: str | None = None) -> DataFrame:
    """Adds n_words, n_syllables and the mono-, polysyllable, complex and simple word counts."""
    df = _split(df, text).withColumn("n_words", X.count_words(F.col("_joined")))
    return _finish_syllables(_syllables(df, _lang(lang))).drop(*_SPLIT)


def long_word_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words and n_long_words."""
    df = _split(df, text).withColumn("n_words", X.count_words(F.col("_joined")))
    return _add(df, X.long_words(F.col("_joined"))).drop(*_SPLIT)


def unique_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_unique_words: distinct lower-cased words of each text."""
    found = F.size(X.unique_words(F.coalesce(F.col(text), F.lit(""))))
    return df.withColumn("n_unique_words", found.cast("bigint"))


def unique_words_by(df: DataFrame, key: str, text: str = "text", approximate: bool = False) -> DataFrame:
    """`(key, n_unique_words)` over all texts of a key.

    The exact count shuffles by (key, word), so a hot key is spread over its words; the
    approximate one shuffles one sketch per key and task.
    """
    rows = df.select(key, F.explode_outer(X.unique_words(F.col(text))).alias("word"))
    distinct = F.approx_count_distinct("word") if approximate else F.count_distinct("word")
    return rows.groupBy(key).agg(distinct.alias("n_unique_words"))


def unique_word_sketches(df: DataFrame, keys: list[str], text: str = "text", precision: int = SKETCH_PRECISION) -> DataFrame:
    """`(keys, words_sketch)`: a HyperLogLog sketch of the distinct lower-cased words of each key.

    A task sends one sketch of about 2^precision bytes a key. Sketches are kept with the feature rows and merged
    later, so a roll-up needs no text.
    """
    rows = df.select(*keys, F.explode_outer(X.unique_words(F.col(text))).alias("word"))
    return rows.groupBy(*keys).agg(F.hll_sketch_agg("word", precision).alias("words_sketch"))


def merged_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """`(keys, words_sketch)` of coarser keys, as if all their texts had been read together."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("words_sketch").alias("words_sketch"))


def sketched_words(sketch: Column) -> Column:
    """About how many distinct words a sketch has seen: off by 1.04 / sqrt(2^precision) as a rule."""
    return F.hll_sketch_estimate(sketch)


def same_words(a: Column, b: Column) -> Column:
    """Whether two sketches have seen the same words, as far as sketches can tell.

    A sketch's estimate also hangs on the order words came in, that of a union on its registers only.
    """
    both = sketched_words(F.hll_union(a, b))
    return (both == sketched_words(F.hll_union(a, a))) & (both == sketched_words(F.hll_union(b, b)))


def _counts(df: DataFrame, text: str, lang: str | None) -> DataFrame:
    """Every count of a text profile, from what `_split` adds."""
    df = _add(_basic(df, text), X.char_class_counts(F.col(text)) | X.long_words(F.col("_joined")))
    return _finish_syllables(_syllables(df, _lang(lang)))


def text_counts(df: DataFrame, text: str = "text", lang: str | None = None) -> DataFrame:
    """Adds every count of a text profile, at the grain of the rows given."""
    return _counts(_split(df, text), text, lang).drop(*_SPLIT)


def readability(df: DataFrame, lang: str | None = None) -> DataFrame:
    """Adds the seven readability metrics to rows that hold counts."""
    return _add(df, readability_columns(F.col, _lang(lang)))


def homogeneity(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_pairs, sum_similarity and avg_similarity (null below two sentences)."""
    return _homogeneity(df.withColumn("_sents", X.sentences(F.coalesce(F.col(text), F.lit(""))))).drop("_sents")


def _homogeneity(df: DataFrame, similarities=adjacent_similarities) -> DataFrame:
    df = df.withColumn("_sims", similarities(F.col("_sents")))
    df = df.withColumns(
        {
            "n_pairs": F.size("_sims").cast("bigint"),
            "sum_similarity": F.aggregate("_sims", F.lit(0.0), lambda total, s: total + s),
        }
    )
    return df.withColumn(
        "avg_similarity", F.try_divide(F.col("sum_similarity"), F.col("n_pairs"))
    ).drop("_sims")


def chunk_texts(
    df: DataFrame, max_length: int, text: str = "text", split: str = "period"
) -> DataFrame:
    """Adds `chunks`: the text itself if short enough, else its pieces packed to `max_length`.

    `split` cuts at periods within windows of `max_length`, or at every sentence.
    """
    df = _fill_text(df, text)
    if split == "period":
        df = df.withColumn("_cuts", C.period_cuts(F.col(text), max_length))
        df = df.withColumn("_pieces", C.pieces_at(F.col(text), F.col("_cuts"))).drop("_cuts")
    elif split == "sentence":
        df = df.withColumn("_pieces", C.sentence_pieces(F.col(text)))
    else:
        raise ValueError("split must be 'period' or 'sentence'")
    df = df.withColumn("_firsts", C.chunk_firsts(F.col("_pieces"), max_length))
    packed = F.when(F.length(text) <= max_length, F.array(F.col(text))).otherwise(
        C.chunks_from(F.col("_pieces"), F.col("_firsts"))
    )
    return df.withColumn("chunks", packed).drop("_pieces", "_firsts")


def explode_chunks(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row `(keys, part_id, text)` per chunk; every text has at least one.

    The outer form is exact here, and keeps Spark from testing the arrays for emptiness first,
    which would compute them twice.
    """
    return df.select(*keys, F.posexplode_outer("chunks").alias("part_id", "text"))


def explode_items(df: DataFrame, keys: list[str], items, names: tuple[str, str]) -> DataFrame:
    """One row `(keys, position, item)` per word or sentence; computed once, as above."""
    rows = df.select(*keys, F.posexplode_outer(items).alias(*names))
    return rows.filter(F.col(names[1]).isNotNull())


def sentence_table(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return explode_items(df, keys, X.sentences(F.col(text)), ("sent_id", "sentence"))


def word_table(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return explode_items(df, keys, X.words(F.col(text)), ("word_id", "word"))


def chunked_readability(
    df: DataFrame,
    key: str,
    max_length: int,
    text: str = "text",
    lang: str | None = None,
    split: str = "period",
) -> DataFrame:
    """`(key, n_parts, metrics)`: the unweighted mean of each metric over a text's chunks.

    Chunks of a text sit in one task, so partial averages leave few rows to shuffle.
    """
    keys = [key] if lang is None else [key, lang]
    parts = explode_chunks(chunk_texts(df, max_length, text, split), keys)
    scored = readability(text_counts(parts, "text", lang), lang)
    return scored.groupBy(key).agg(
        F.count("*").alias("n_parts"), *[F.avg(m).alias(m) for m in READABILITY_METRICS]
    )


def split_and_counted(df: DataFrame, text: str = "text", lang: str | None = None) -> DataFrame:
    """All counts, distinct words and homogeneity of every text, beside the parts they are taken from (`_SPLIT`)."""
    counted = _homogeneity(_counts(_split(df, text), text, lang))
    return counted.withColumn("n_unique_words", F.size(X.unique_of_joined(F.col("_joined"))).cast("bigint"))


def profile_documents(
    df: DataFrame, keys: list[str], text: str = "text", lang: str | None = None
) -> DataFrame:
    """Counts, readability and homogeneity of every document; row-wise."""
    counted = split_and_counted(df, text, lang).withColumn(
        "avg_word_length", X.mean_word_length(F.col("n_word_chars"), F.col("n_words"))
    )
    return readability(counted, lang).select(
        *keys,
        *SUMMED_COUNTS,
        "n_unique_words",
        "avg_word_length",
        *READABILITY_METRICS,
        "n_pairs",
        "sum_similarity",
        "avg_similarity",
    )


def _dataset_sums(counted: DataFrame, key: str, counts: list[str], amount: str, words: Column) -> DataFrame:
    """`(key, counts, amount, n_unique_words)` from one scan and one map-side combined aggregation.

    Every text gives a row for each count and one for each of its distinct words. Both are summed by (key, place,
    word), so the counts leave a row for each task and a hot key is spread over its words.
    """

    def row(place: int, word: Column, n: Column, x: Column) -> Column:
        return F.struct(F.lit(place).alias("place"), word.alias("word"), n.alias("n"), x.alias("x"))

    no_word, no_amount = F.lit(None).cast("string"), F.lit(None).cast("double")
    fixed = [row(i, no_word, F.col(c), no_amount) for i, c in enumerate(counts)]
    fixed.append(row(len(counts), no_word, F.lit(0).cast("bigint"), F.col(amount)))
    of_words = F.transform(words, lambda w: row(-1, w, F.lit(1).cast("bigint"), no_amount))
    rows = counted.select(key, F.inline_outer(F.concat(F.array(*fixed), of_words)))
    summed = rows.groupBy(key, "place", "word").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    at = lambda i, c: F.when(F.col("place") == i, F.col(c))
    return summed.groupBy(key).agg(
        *[F.sum(at(i, "n")).alias(c) for i, c in enumerate(counts)],
        F.sum(at(len(counts), "x")).alias(amount),
        F.count(at(-1, "word")).alias("n_unique_words"),
    )


def profile_datasets(
    df: DataFrame,
    key: str,
    text: str = "text",
    lang: str | None = None,
    with_words: bool = True,
    with_similarity: bool = True,
) -> DataFrame:
    """The same profile per dataset.

    Counts add up, words are distinct over the dataset, readability follows from the summed
    counts (Russian coefficients where most words are in Russian texts), and homogeneity is
    the mean over all pairs within documents. Texts are read once. Distinct words and homogeneity
    can be left out, which makes them null and saves their work.
    """
    counted = _counts(_split(df, text), text, lang)
    if with_similarity:
        counted = _homogeneity(counted, adjacent_similarities_in_batches)
    else:
        counted = counted.withColumns({"n_pairs": F.lit(None).cast("bigint"), "sum_similarity": F.lit(None).cast("double")})
    ru_words = F.when(F.col(lang) == "ru", F.col("n_words")) if lang else F.lit(None)
    counted = counted.withColumns({"ru_words": ru_words.cast("bigint"), "n_docs": F.lit(1).cast("bigint")})
    counts = ["n_docs", *SUMMED_COUNTS, "n_pairs", "ru_words"]
    if with_words:
        totals = _dataset_sums(counted, key, counts, "sum_similarity", X.unique_of_joined(F.col("_joined")))
    else:
        # plain sums: those that nothing asks for are not computed
        totals = counted.groupBy(key).agg(*[F.sum(c).alias(c) for c in (*counts, "sum_similarity")])
        totals = totals.withColumn("n_unique_words", F.lit(None).cast("bigint"))
    return finish_datasets(totals, key)


def finish_datasets(totals: DataFrame, key: str) -> DataFrame:
    """What follows from a dataset's summed counts, `ru_words` and `n_unique_words` among them."""
    totals = totals.withColumns(
        {
            "_lang": F.when(F.col("ru_words") * 2 > F.col("n_words"), "ru").otherwise("other"),
            "avg_word_length": X.mean_word_length(F.col("n_word_chars"), F.col("n_words")),
            "avg_similarity": F.try_divide(F.col("sum_similarity"), F.col("n_pairs")),
        }
    )
    return readability(totals, "_lang").select(
        key,
        "n_docs",
        *SUMMED_COUNTS,
        "n_unique_words",
        "avg_word_length",
        *READABILITY_METRICS,
        "n_pairs",
        "sum_similarity",
        "avg_similarity",
    )
