"""Language detection from character n-gram frequencies learned from labelled texts.

After Cavnar & Trenkle (1994): n-grams of 1 to 3 characters within words, padded with a
blank at both ends. A text is scored per language by the sum of the smoothed log frequencies
of its n-grams: each n-gram known in any language counts once more than it was seen in each, so
none is dropped and one that a language lacks has that language's default.

A word's n-grams are the same wherever it stands, so every distinct word is scored once and texts look their
words up. Tables within BROADCAST_BYTES are broadcast. Of a larger vocabulary the most frequent words are, and
the n-grams of the others are looked up where they stand, so no word of a text is shuffled. Only where the
n-grams themselves are too many rows are joined by a shuffle, the keys with a HOT_SHARE of all rows or more
apart from the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigauge.functions.text import analysis_language
from lexigauge.session import broadcast_within, materialize

BROADCAST_BYTES = 128 << 20
#: Bytes a broadcast row takes beside its numbers: a key of some letters and its place in a hash table.
ROW_BYTES = 96
#: Keys with such a share of all rows are hot; there are at most 1 / HOT_SHARE.
HOT_SHARE = 1 / 4096
#: Stands for the n-grams a language does not have.
DEFAULT = ""


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def word_grams(word: Column) -> Column:
    """All n-grams of one word, with repeats; overlapping windows by lookahead."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.concat(
        F.regexp_extract_all(word, F.lit("."), F.lit(0)),
        F.regexp_extract_all(padded, F.lit("(?=(..))"), F.lit(1)),
        F.regexp_extract_all(padded, F.lit("(?=(...))"), F.lit(1)),
    )


def _vocabulary(docs: DataFrame, text: str, keys: list[Column]) -> DataFrame:
    words = docs.select(*keys, F.explode_outer(letter_words(F.col(text))).alias("word"))
    names = words.columns
    return words.filter(F.col("word").isNotNull()).groupBy(*names).agg(F.count("*").alias("n"))


def fit_profile(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """`(lang, gram, weight)`: 1000 ln((n + 1) / (total + kinds)), rounded, of every n-gram of a language.

    `kinds` counts the different n-grams of all languages. A row with an empty `gram` has the
    weight of those that the language lacks. Words are counted before their n-grams are taken, and
    the counts are written, so texts are read once. Weights are integers: sums of them do not
    depend on the order of rows.
    """
    labelled = docs.filter(F.col(lang).isNotNull())
    vocabulary = _vocabulary(labelled, text, [F.col(lang).alias("lang")])
    counts = materialize(
        vocabulary.select("lang", "n", F.explode_outer(word_grams(F.col("word"))).alias("gram"))
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n")),
        "gram_counts",
    )
    kinds = counts.select("gram").distinct().agg(F.count("*")).scalar()
    totals = counts.groupBy("lang").agg((F.sum("n") + F.first(kinds)).alias("total"))
    unseen = totals.select("lang", F.lit(DEFAULT).alias("gram"), F.lit(0).cast("bigint").alias("n"), "total")
    known = counts.join(totals, "lang").select("lang", "gram", "n", "total")
    share = (F.col("n") + 1) / F.col("total")
    return known.unionByName(unseen).select("lang", "gram", F.round(1000 * F.ln(share)).cast("bigint").alias("weight"))


def profile_languages(profile: DataFrame) -> list[tuple[str, int]]:
    """The languages of a profile, in order, with their defaults. A handful of rows, read by the driver."""
    return [(r.lang, r.weight) for r in profile.filter(F.col("gram") == DEFAULT).orderBy("lang").collect()]


def _wide(profile: DataFrame, langs: list[tuple[str, int]]) -> DataFrame:
    """One row per n-gram with `w0..`: what each language gives it above its default."""
    names = [lang for lang, _ in langs]
    weights = profile.filter(F.col("gram") != DEFAULT).groupBy("gram").pivot("lang", names).agg(F.first("weight"))
    above = [F.coalesce(F.col(f"`{lang}`") - F.lit(least), F.lit(0)).alias(f"w{i}") for i, (lang, least) in enumerate(langs)]
    return weights.select("gram", *above)


def _most(numbers: int) -> int:
    """Rows with so many numbers that may be broadcast."""
    return BROADCAST_BYTES // (ROW_BYTES + 8 * numbers)


def _fits(table: DataFrame, numbers: int) -> bool:
    most = _most(numbers)
    return table.limit(most + 1).count() <= most


def _frequent(words: DataFrame, numbers: int) -> DataFrame:
    """The rows of a written table of words with the largest `n` that may be broadcast, by powers of two."""
    level = F.floor(F.log2("n"))
    left, least = _most(numbers), 64
    # at most 63 rows
    for found, rows in sorted(words.groupBy(level.alias("level")).agg(F.count("*")).collect(), reverse=True):
        if rows > left:
            break
        left, least = left - rows, found
    return words.filter(level >= least)


def look_up(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """`rows` left-joined to a written `table` by `key`: by broadcast if it fits, else without a hot key in one task.

    hot: the keys, at most 1 / HOT_SHARE, that are broadcast with their values. Rows with such
    a key are dealt by their hash in the shuffle for the others. A key is one or more letters or blanks.
    """
    values = [c for c in table.columns if c != key]
    if _fits(table, len(values)):
        return rows.join(F.broadcast(table), key, "left")
    few = broadcast_within(materialize(table.join(F.broadcast(hot), key).withColumn("_hot", F.lit(True)), "hot"), int(1 / HOT_SHARE))
    first = rows.join(few, key, "left")
    # no key is a number, so these meet nothing
    spread = F.when(F.col("_hot"), F.xxhash64(*rows.columns).cast("string")).otherwise(F.col(key))
    rest = table.select(F.col(key).alias("_cold"), *[F.col(c).alias(f"_{c}") for c in values])
    met = first.withColumn("_cold", spread).join(rest, "_cold", "left")
    return met.select(*rows.columns, *[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in values])


def word_weights(docs: DataFrame, profile: DataFrame, text: str = "text") -> DataFrame:
    """`(word, n, n_grams, n_known, h0..)` of every distinct word of `docs`, written.

    n: how often it stands in them; h0..: the summed weights of its n-grams above the defaults of the languages, in
    the order of `profile_languages`; n_known: its n-grams that any language has.
    """
    langs = profile_languages(profile)
    wide = materialize(_wide(profile, langs), "wide_profile")
    return _weighed(materialize(_vocabulary(docs, text, []), "vocabulary"), wide, len(langs))


def _weighed(vocabulary: DataFrame, wide: DataFrame, langs: int) -> DataFrame:
    pieces = vocabulary.select("word", "n", F.explode_outer(word_grams(F.col("word"))).alias("gram"))
    # n-grams that stand in a large part of all words; with 1 / HOT_SHARE letters or fewer there can't be more
    per_gram = pieces.groupBy("gram").agg(F.count("*").alias("k"))
    total = pieces.agg(F.count("*")).scalar()
    hot = per_gram.filter(F.col("k") >= HOT_SHARE * total).select("gram")
    known = look_up(pieces, wide.withColumn("known", F.lit(1)), "gram", hot)
    sums = [F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"h{i}") for i in range(langs)]
    summed = known.groupBy("word").agg(
        F.max("n").alias("n"), F.count("*").alias("n_grams"), F.coalesce(F.sum("known"), F.lit(0)).alias("n_known"), *sums
    )
    return materialize(summed, "word_weights")


def _scored_in_place(rows: DataFrame, few: DataFrame, wide: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """`sums` of `rows(key, word)`: the words of `few` looked up, the n-grams of the others; only sums are shuffled."""
    found = rows.join(F.broadcast(few.drop("n")), "word", "left")
    grams = F.when(F.col("n_grams").isNull(), word_grams(F.col("word")))
    pieces = found.select(key, *sums, F.explode_outer(grams).alias("gram"))
    known = pieces.join(F.broadcast(wide.withColumn("known", F.lit(1))), "gram", "left")
    of_gram = {"n_grams": F.when(F.col("gram").isNotNull(), 1), "n_known": F.col("known")}
    value = lambda c: F.coalesce(F.col(c), of_gram.get(c, F.col(f"w{c[1:]}") if c[0] == "h" else None))
    return known.groupBy(key).agg(*[F.sum(value(c)).alias(c) for c in sums])


def language_scores(
    docs: DataFrame, profile: DataFrame, key: str, text: str = "text", words: DataFrame | None = None
) -> DataFrame:
    """`(key, scores)`: an array of `(lang, score)`, scores null without any known n-gram.

    `profile` should be a written table; `words` is the table of `word_weights` over these or
    more texts, made here if none is given.
    """
    langs = profile_languages(profile)
    places = range(len(langs))
    sums = ["n_grams", "n_known", *[f"h{i}" for i in places]]
    rows = docs.select(key, F.explode_outer(letter_words(F.col(text))).alias("word"))
    table, few = words, None
    if words is None or not _fits(words, len(sums)):
        wide = materialize(_wide(profile, langs), "wide_profile")
        vocabulary = materialize(_vocabulary(docs, text, []), "vocabulary") if words is None else words
        if not _fits(vocabulary, len(sums)) and _fits(wide, len(langs) + 1):
            few = _frequent(vocabulary, len(sums))
        if words is None:
            table = _weighed(vocabulary if few is None else few, wide, len(langs))
            few = None if few is None else table
    if few is not None:
        summed = _scored_in_place(rows, few, wide, key, sums)
    elif _fits(table, len(sums)):
        # all words of a text are looked up and summed within its task
        found = rows.join(F.broadcast(table.drop("n")), "word", "left")
        summed = found.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums])
    else:
        total = table.agg(F.sum("n")).scalar()
        hot = table.filter(F.col("n") >= HOT_SHARE * total).select("word")
        # texts without words keep a row
        counted = rows.groupBy(key, "word").agg(F.count("*").alias("times"))
        found = look_up(counted, table.drop("n"), "word", hot)
        summed = found.groupBy(key).agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in sums])
    score = [
        F.when(F.col("n_known") > 0, F.col(f"h{i}") + F.col("n_grams") * F.lit(least)).cast("bigint")
        for i, (_, least) in enumerate(langs)
    ]
    pairs = [F.struct(F.lit(lang).alias("lang"), s.alias("score")) for (lang, _), s in zip(langs, score)]
    typed = F.array(*pairs) if pairs else F.array().cast("array<struct<lang:string,score:bigint>>")
    return summed.select(key, typed.alias("scores"))


def detect_language(
    docs: DataFrame, profile: DataFrame, key: str, text: str = "text", words: DataFrame | None = None
) -> DataFrame:
    """`(key, detected_lang, analysis_lang)`: best-scoring language, first by name on a tie.

    Both are null for a text that shares no n-gram with any language, such as one without
    letters.
    """
    ranked = F.transform(
        F.filter("scores", lambda s: s["score"].isNotNull()),
        lambda s: F.struct((-s["score"]).alias("cost"), s["lang"].alias("lang")),
    )
    found = language_scores(docs, profile, key, text, words).select(
        key, F.array_min(ranked)["lang"].alias("detected_lang")
    )
    routed = F.when(F.col("detected_lang").isNotNull(), analysis_language(F.col("detected_lang")))
    return found.withColumn("analysis_lang", routed)
