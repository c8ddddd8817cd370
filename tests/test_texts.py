import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigauge.fixed_values import READABILITY_METRICS
from lexigauge.functions.homogeneity import multiset_cosine
from lexigauge.operators import text_profile as T

from .conftest import optimized, physical


def texts(spark, rows):
    return spark.createDataFrame(
        [(i, "d", t, lang) for i, (t, lang) in enumerate(rows)],
        "doc_id long, dataset_name string, text string, lang string",
    )


def period_pieces(text, size):
    out, start = [], 0
    while start < len(text):
        window = text[start : start + size]
        last = window.rfind(".")
        out.append(window[: last + 1] if last > 0 else window)
        start += len(out[-1])
    return out


def packed(pieces, size):
    chunks = []
    for piece in pieces:
        if chunks and sum(map(len, chunks[-1])) + len(piece) <= size:
            chunks[-1].append(piece)
        else:
            chunks.append([piece])
    return [" ".join(c) for c in chunks]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 12, 60])
def test_chunks_against_brute_force(spark, size):
    rng = random.Random(size)
    sample = ["", ".", "...", "no period", ".starts", "fits. ", "a" * 200, "x." * 50]
    sample += ["".join(rng.choice("ab. .é😀\n") for _ in range(rng.randint(0, 50))) for _ in range(300)]
    df = T.chunk_texts(texts(spark, [(t, "en") for t in sample]), size)
    for row in df.collect():
        want = [row.text] if len(row.text) <= size else packed(period_pieces(row.text, size), size)
        assert row.chunks == want


def test_sentence_chunks_keep_sentences_whole(spark):
    df = T.chunk_texts(texts(spark, [("Aa bb. Cc! Dddddddddddd dd? E", "en")]), 11, split="sentence")
    assert df.first().chunks == ["Aa bb.  Cc!", " Dddddddddddd dd?", " E"]


def test_null_and_empty_texts(spark):
    rows = texts(spark, [(None, "en"), ("", "en"), ("--- ...", "en")])
    counted = T.profile_documents(rows, ["doc_id"], lang="lang").orderBy("doc_id").collect()
    assert [r.n_words for r in counted] == [0, 0, 0]
    assert [r.n_sents for r in counted] == [0, 0, 0]
    assert [r.avg_word_length for r in counted] == [0.0, 0.0, 0.0]
    assert all(r.flesch_reading_easy is None and r.avg_similarity is None for r in counted)
    total = T.profile_datasets(rows, "dataset_name", lang="lang").first()
    assert (total.n_docs, total.n_words, total.n_unique_words, total.n_chars) == (3, 0, 0, 7)


def test_english_counts(spark):
    row = T.unique_words(T.text_counts(texts(spark, [("The cat sat. Beautiful cats run! A", "en")]))).first()
    assert (row.n_words, row.n_sents, row.n_unique_words) == (7, 3, 7)
    # the-cat-sat-beau-ti-ful-cats-run-a; beautiful has three vowel groups
    assert (row.n_syllables, row.n_monosyllable_words, row.n_polysyllable_words) == (9, 6, 1)
    assert (row.n_complex_words, row.n_simple_words, row.n_long_words) == (1, 6, 1)
    assert (row.n_letters, row.n_spaces, row.n_punctuations, row.n_chars) == (26, 6, 2, 34)


def test_russian_counts(spark):
    rows = [
        ("Мама мыла раму. Длинноволосая кошка!", "ru"),
        ("В лесу", "ru"),
        ("Параллелограмм и test", "ru"),
        ("", "ru"),
        ("Ёж ел", "ru"),
    ]
    counted = T.text_counts(texts(spark, rows), lang="lang").orderBy("doc_id").collect()
    assert [r.n_words for r in counted] == [5, 2, 3, 0, 2]
    # "В" has no vowel and counts one syllable
    assert [r.n_syllables for r in counted] == [14, 3, 7, 0, 2]
    assert [r.n_complex_words for r in counted] == [1, 0, 1, 0, 0]
    assert [r.n_monosyllable_words for r in counted] == [0, 1, 2, 0, 2]
    assert [r.n_long_words for r in counted] == [1, 0, 1, 0, 0]


def test_readability_formulas(spark):
    counts = dict(n_words=100, n_sents=5, n_syllables=150, n_complex_words=10, n_letters=450, n_long_words=20)
    df = spark.createDataFrame([("en", *counts.values()), ("ru", *counts.values())], ["lang", *counts])
    en, ru = T.readability(df, "lang").collect()
    assert en.flesch_reading_easy == pytest.approx(206.835 - 1.015 * 20 - 84.6 * 1.5)
    assert en.gunning_fog == pytest.approx(0.4 * (20 + 10))
    assert en.smog_index == pytest.approx(1.043 * math.sqrt(30 * 10 / 5) + 3.1291)
    assert en.automated_readability_index == pytest.approx(4.71 * 4.5 + 0.5 * 20 - 21.43)
    assert en.coleman_liau_index == pytest.approx(0.0588 * 450 - 0.296 * 5 - 15.8)
    assert en.flesch_kincaid_grade == pytest.approx(0.39 * 20 + 11.8 * 1.5 - 15.59)
    assert en.lix == pytest.approx(20 + 20)
    assert ru.flesch_reading_easy == pytest.approx(206.835 - 1.3 * 20 - 60.1 * 1.5)


def test_smog_needs_three_sentences(spark):
    scored = T.readability(T.text_counts(texts(spark, [("One. Two.", "en")]))).first()
    assert scored.smog_index == 0.0


def brute_similarity(a, b):
    shared = sum((Counter(a) & Counter(b)).values())
    return shared / math.sqrt(len(a) * len(b))


def test_homogeneity(spark):
    rows = [("Same one.Same one.", "en"), ("Aab é😀. Baé😀c! Zz", "en"), ("Single.", "en")]
    got = T.homogeneity(texts(spark, rows)).orderBy("doc_id").collect()
    assert got[0].avg_similarity == pytest.approx(1.0)
    pairs = [brute_similarity("Aab é😀.", "Baé😀c!"), brute_similarity("Baé😀c!", "Zz")]
    assert got[1].avg_similarity == pytest.approx(sum(pairs) / 2)
    assert (got[2].n_pairs, got[2].avg_similarity) == (0, None)


def test_documents_sum_to_datasets(spark):
    rows = [(f"Word{i % 3} and text. More {i} here!", "ru" if i == 1 else "en") for i in range(20)]
    df = texts(spark, rows)
    by_doc = T.profile_documents(df, ["doc_id"], lang="lang")
    total = T.profile_datasets(df, "dataset_name", lang="lang").first()
    for column in ("n_chars", "n_words", "n_sents", "n_syllables", "n_pairs", "n_complex_words"):
        assert by_doc.agg(F.sum(column)).first()[0] == total[column]
    assert total.n_docs == 20
    assert total.n_unique_words == T.unique_words_by(df, "dataset_name").first().n_unique_words


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_results_do_not_depend_on_partitions(spark, parts):
    rows = [(f"Some text {i % 7}. And more, again {i}!", "en") for i in range(100)]
    df = texts(spark, rows)
    names = ["n_words", "n_unique_words", *READABILITY_METRICS, "avg_similarity"]
    once = T.profile_datasets(df.coalesce(1), "dataset_name").first()
    other = T.profile_datasets(df.repartition(parts), "dataset_name").first()
    assert [other[n] for n in names] == pytest.approx([once[n] for n in names])


def test_long_junk_lines_stay_cheap(spark):
    junk = "=" * 200_000 + "a" * 200_000 + " " * 200_000 + "1" * 200_000
    row = T.profile_documents(texts(spark, [(junk, "en")]), ["doc_id"]).first()
    assert (row.n_words, row.n_sents, row.n_syllables) == (2, 1, 2)


def test_document_grain_has_no_shuffle_and_no_python(spark):
    df = texts(spark, [("a", "en")])
    plan = physical(T.profile_documents(df, ["doc_id"], lang="lang"))
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_chunk_steps_are_not_repeated(spark):
    df = T.explode_chunks(T.chunk_texts(texts(spark, [("a", "en")]), 500), ["doc_id"])
    plan = optimized(df)
    # once the runs up to a period, once the blocks that pieces are taken from
    assert plan.count("[^.]*") == 1 and plan.count("(?s).{1,") == 1 and plan.count("regexp_extract_all") == 2


def test_splits_are_not_repeated(spark):
    df = texts(spark, [("a b. c", "en")])
    assert optimized(T.word_table(df, ["doc_id"])).count("regexp_extract_all") == 1
    assert optimized(T.sentence_table(df, ["doc_id"])).count("regexp_extract_all") == 1


@pytest.mark.parametrize("limit", [1, 7, 60, 5000])
def test_long_texts_are_cut_as_short_ones(spark, limit):
    """More runs, pieces and blocks of text than a block of the fold holds."""
    rnd = random.Random(limit)
    made = ["".join(rnd.choice(["ab", "é", ".", " ", "\n", "😀", "word "]) for _ in range(n)) for n in (0, 1, 9, 900, 12_000)]
    made += ["." * 3000, "x" * 3000, ".x" * 2000 + "." * 50, "x" * 1500 + "." + "y" * 1500]
    rows = T.chunk_texts(texts(spark, [(t, "en") for t in made]), limit).select("text", "chunks").collect()
    for r in rows:
        want = [r.text] if len(r.text) <= limit else packed(period_pieces(r.text, limit), limit)
        assert r.chunks == want


@pytest.mark.parametrize("split", ["period", "sentence"])
def test_chunking_is_linear(spark, split):
    rnd = random.Random(0)
    text = "".join(rnd.choice(["the cat sat on a mat", "word ", "x. ", "é und. ", "\n"]) for _ in range(600_000))

    def seconds(n):
        df = texts(spark, [(text[:n], "en")]).cache()
        df.count()
        taken = []
        for _ in range(2):
            started = time.perf_counter()
            T.explode_chunks(T.chunk_texts(df, 500, split=split), ["doc_id"]).agg(F.sum(F.length("text"))).collect()
            taken.append(time.perf_counter() - started)
        df.unpersist()
        return min(taken)

    seconds(500_000)
    assert seconds(4_000_000) <= 2.5 * seconds(2_000_000)


def plain_similarity(a, b):
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / math.sqrt(len(a) * len(b))


def test_long_sentences_are_compared_as_short_ones(spark):
    rnd = random.Random(3)
    kinds = ["ab c", "the cat", "日本語" + "".join(map(chr, range(0x4E00, 0x5A00))), "\U0001f600é\n", "x", "$^\\.*"]
    pairs = [
        tuple("".join(rnd.choices(rnd.choice(kinds), k=n)) for n in (size, rnd.randint(1, size)))
        for size in (1, 10, 1500, 3000, 40_000)
        for _ in range(6)
    ] + [("x" * 300_000, "y" * 5000), ("x" * 300_000, "x" * 5000 + "z")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", multiset_cosine(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == pytest.approx(plain_similarity(r.a, r.b), abs=1e-12)


def test_similarity_of_lines_without_stops_is_linear(spark):
    """Sentences of a million characters, thousands of them different."""
    rnd = random.Random(1)
    letters = [chr(0x4E00 + i) for i in range(6000)] + list("abcdefgh ")
    line = "".join(rnd.choices(letters, k=1_000_000))

    def seconds(n):
        df = texts(spark, [(f"{line[:n]}. {line[-n:]}.", "en")]).cache()
        df.count()
        taken = []
        for _ in range(2):
            started = time.perf_counter()
            assert T.homogeneity(df).first().n_pairs == 1
            taken.append(time.perf_counter() - started)
        return min(taken)

    seconds(100_000)
    assert seconds(1_000_000) <= 2.5 * 2.5 * seconds(250_000)
