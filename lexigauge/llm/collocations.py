"""Phrase collocations by the stripes pattern: each prefix of words keys a counter of the words behind it.

A stripe is (lang, prefix, next words, counts). A task counts a block of texts at once and sends one stripe for each prefix
of the block; stripes of a prefix are merged word by word. Prefixes of 0 to 3 words give all phrases of 1 to 4
words: a phrase's count stands in the stripe of its prefix, the counts of its parts in the stripes of theirs, and the
largest count in the stripe of a phrase is that of the likeliest phrase that subsumes it from the right. The stripe without a
prefix is kept as rows (lang, word, count), since it has all words; its sum is the size of the language.

Only words, and then pairs, that occur LEAST times or more are parts of a phrase that does. They are known
from the stripes before and reach the tasks as a bit filter whose size follows their number, up to MAX_BITS;
beyond that, or by chance, a rare phrase passes it, which costs time and changes nothing: what counts is the merged
stripe. A word with more than a SLICES-th of all words has its stripes cut into slices by the hash of the next
word, so that no stripe gathers a large part of the corpus in one task; there are fewer than SLICES such words.

A phrase is subsumed if a longer one holds it in a row and has SUBSUMED percent of its count; one more word to either side is
enough to know, as no longer phrase occurs oftener than those it holds. Scores are whole numbers of 38 digits.

Null and empty texts have no words; a null language is `und`. Repeated rows count each. A long text is cut between
pieces, so that a task holds some times BLOCK bytes, and a piece at least. Ties in rank go to the smaller phrase by its
bytes. An empty table gives no rows. Columns other than text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import UPPER, arrow_batches

LEAST = 30
LONGEST = 4
SUBSUMED = 80
SCALE = 2_000_000
TOP = 2000
#: Bytes of text that a task counts at once.
BLOCK = 12_000_000
#: Bits of a filter for each phrase in it, and its largest size (64 MB).
BITS_EACH, MAX_BITS = 16, 1 << 29
FILTER_BLOCK = 1 << 19
SLICES = 4096
#: Salts of the first round of ranking.
SALTS = 64

BREAK = b"."
#: A-Z to a-z; marks and line ends to BREAK.
TABLE = bytes.maketrans(UPPER.encode() + b",;:!?\n\x0b\x0c\r", UPPER.lower().encode() + BREAK * 9)


def word_hashes(words: list[bytes], lang: bytes) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(lang + b"\0" + w) for w in words], np.uint64)


def mixed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The hashes of phrases that go on by a word."""
    h = (first * np.uint64(0x9E3779B97F4A7C15)) ^ then
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a filter of `bits` bits, a power of 2."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return h >> shift, (h * np.uint64(0x94D049BB133111EB)) >> shift


def passes(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = probes(h, len(filter_) * 8)
    bit = lambda at: (filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    return (bit(a) & bit(b)).astype(bool)


def frequent_filter(phrases: DataFrame) -> np.ndarray:
    """A bit filter of (lang, phrase) as bytes: every phrase passes, few others. Of at most MAX_BITS bits."""
    n = phrases.count()
    bits = min(MAX_BITS, max(FILTER_BLOCK, 1 << (max(n, 1) * BITS_EACH - 1).bit_length()))

    def mark(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = word_hashes(phrase.encode().split(b" "), lang.encode())
                h = words[:1]
                for i in range(1, len(words)):
                    h = mixed(h, words[i : i + 1])
                for at in probes(h, bits):
                    found[int(at[0]) >> 3] |= 1 << (int(at[0]) & 7)
        blocks = found.reshape(-1, FILTER_BLOCK // 8)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([blocks[k].tobytes() for k in used], pa.binary())], names=["block", "bits"])

    def merge(pdf):
        import pandas as pd

        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]])
        return pd.DataFrame({"block": pdf["block"][:1].to_numpy(), "bits": [bits.tobytes()]})

    marked = phrases.select("lang", "phrase").mapInArrow(mark, "block int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    # at most MAX_BITS bits in all
    for row in marked.groupBy("block").applyInPandas(merge, "block int, bits binary").toLocalIterator():
        out[row.block * FILTER_BLOCK // 8 : (row.block + 1) * FILTER_BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def _blocks(batches: Iterator, size: int) -> Iterator[tuple[str, bytes]]:
    """(lang, texts) of about `size` bytes of one language each, cut between pieces; BREAK for every mark."""
    import pyarrow as pa

    held, total = {}, 0
    for batch in batches:
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        for lang, text in zip(langs, texts, strict=True):
            text, at = (text.as_py() or b"").translate(TABLE), 0
            while at < len(text):
                end = text.find(BREAK, at + size) + 1 or len(text)
                held.setdefault("und" if lang is None else lang, []).append(text[at:end])
                total, at = total + end - at, end
                if total >= size:
                    yield from ((g, BREAK.join(parts)) for g, parts in held.items())
                    held, total = {}, 0
    yield from ((g, BREAK.join(parts)) for g, parts in held.items())


def coded(text: bytes):
    """The number of each word, the words by number, and whether the word behind it is in the same piece."""
    import pyarrow as pa

    points = np.frombuffer(text, np.uint8)
    is_mark = points == ord(BREAK)
    in_word = ~((points == 32) | (points == 9) | is_mark)
    starts = np.flatnonzero(in_word & ~np.append(False, in_word[:-1]))
    sizes = np.flatnonzero(in_word & ~np.append(in_word[1:], False)) + 1 - starts
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(points[in_word])).dictionary_encode()
    piece = np.cumsum(is_mark, dtype=np.int32)[starts]
    goes_on = np.append(piece[1:] == piece[:-1], False)[: len(starts)]
    return words.indices.to_numpy().astype(np.int64), words.dictionary, goes_on


def _count_words(block: int, batches: Iterator) -> Iterator:
    import pyarrow as pa

    for lang, text in _blocks(batches, block):
        ids, known, _ = coded(text)
        # under null all words of the block
        phrases = pa.concat_arrays([known, pa.nulls(1, pa.string())])
        counts = np.append(np.bincount(ids, minlength=len(known)), len(ids))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), phrases, pa.array(counts)], names=["lang", "phrase", "f"])


def block_stripes(lang: str, text: bytes, sizes: tuple[int, ...], filter_: np.ndarray, slices: dict[str, int]) -> Iterator:
    """The stripes of a block: for each of `sizes`, tables (lang, prefix, slice, words, counts) of prefixes of so many words.

    All runs of sizes[0] words in a counted phrase pass the filter.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    ids, known, goes_on = coded(text)
    if not len(ids):
        return
    hashes = word_hashes([w.encode() for w in known.to_pylist()], lang.encode())
    cuts = np.ones(len(known), np.uint64)
    heavy = pc.index_in(pa.array(list(slices), pa.string()), known)
    cuts[heavy.drop_null().to_numpy()] = np.array(list(slices.values()), np.uint64)[heavy.is_valid().to_numpy(zero_copy_only=False)]
    base, size = sizes[0], len(known)
    n = len(ids)
    # runs of `base` words by their start; those that don't fit pass nothing
    h, passing = hashes[ids], np.ones(n, bool)
    for i in range(1, base):
        h = mixed(h[:-1], hashes[ids[i:]])
        passing = passing[:-1] & goes_on[i - 1 : n - 1]
    passing &= passes(filter_, h)
    for k in sizes:
        counted = passing[: max(n - k, 0)].copy()
        for i in range(1, k + 1):
            at = slice(i, i + len(counted))
            counted &= goes_on[i - 1 : i - 1 + len(counted)]
            if i <= k + 1 - base:
                counted &= passing[at]
        at = np.flatnonzero(counted)
        if not len(at):
            continue
        prefix, places = ids[at], np.empty(size, np.int64)
        places[prefix] = at
        for i in range(1, k):
            # a place of each prefix, by its number
            _, first, prefix = np.unique(prefix * size + ids[at + i], return_index=True, return_inverse=True)
            places = at[first]
        pairs, counts = np.unique(prefix * size + ids[at + k], return_counts=True)
        prefix, then = pairs // size, pairs % size
        slot = (hashes[then] % cuts[ids[places[prefix] + k - 1]]).astype(np.int64)
        order = np.lexsort((slot, prefix))
        prefix, then, slot, counts = prefix[order], then[order], slot[order], counts[order]
        starts = np.flatnonzero(np.append(True, (np.diff(prefix) != 0) | (np.diff(slot) != 0)))
        offsets = np.append(starts, len(prefix)).astype(np.int32)
        spots = places[prefix[starts]]
        texts = [known.take(pa.array(ids[spots + i])) for i in range(k)]
        yield pa.Table.from_arrays(
            [
                pa.array([lang] * len(starts)),
                pc.binary_join_element_wise(*texts, " ") if k > 1 else texts[0],
                pa.array(slot[starts].astype(np.int32)),
                *_packed(offsets, known.take(pa.array(then)), counts),
            ],
            names=["lang", "prefix", "slice", "words", "counts"],
        )


#: A part of a stripe on its way: the words in one text, the counts as bytes.
PART = "lang string, prefix string, slice int, words string, counts binary"
STRIPE = "lang string, prefix string, slice int, words array<string>, counts array<long>"


def _packed(offsets: np.ndarray, words, counts: np.ndarray) -> list:
    """The words and counts of stripes as columns of PART."""
    import pyarrow as pa
    import pyarrow.compute as pc

    data = [None, pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(counts.astype("<i8"))]
    return [pc.binary_join(pa.ListArray.from_arrays(offsets, words), " "), pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, data)]


def _merged(rows):
    """(first row, place of each count's stripe, word, words, counts): stripes of one prefix and slice put together, word by word."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = rows.combine_chunks()
    changed = np.zeros(len(rows), bool)
    changed[0] = True
    for name in ("lang", "prefix", "slice"):
        column = rows.column(name).combine_chunks()
        code = column.to_numpy() if name == "slice" else column.dictionary_encode().indices.to_numpy()
        changed[1:] |= code[1:] != code[:-1]
    words = pc.split_pattern(rows.column("words").combine_chunks(), " ")
    run = np.repeat(np.cumsum(changed) - 1, np.diff(words.offsets.to_numpy()))
    coded_words = words.flatten().dictionary_encode()
    size = len(coded_words.dictionary)
    keys = run * size + coded_words.indices.to_numpy()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    counts = np.add.reduceat(np.frombuffer(b"".join(rows.column("counts").to_pylist()), "<i8")[order], starts)
    return rows.take(pa.array(np.flatnonzero(changed))), keys[starts] // size, keys[starts] % size, coded_words.dictionary, counts


def merge_stripes(least: int, batches: Iterator, at_once: int = 20_000) -> Iterator:
    """Whole stripes from parts that come sorted, with the words of `least` or more; those without such a word are left out."""
    import pyarrow as pa

    def offsets(head, run):
        return np.append(0, np.cumsum(np.bincount(run, minlength=len(head)))).astype(np.int32)

    def whole(head, run, then, known, counts):
        kept = counts >= least
        rows, run = np.unique(run[kept], return_inverse=True)
        head, at = head.take(pa.array(rows)), pa.array(offsets(rows, run))
        lists = [pa.ListArray.from_arrays(at, v) for v in (known.take(pa.array(then[kept])), pa.array(counts[kept]))]
        return pa.Table.from_arrays([*(head.column(c) for c in ("lang", "prefix", "slice")), *lists], names=names).to_batches(max_chunksize=20_000)

    names = ["lang", "prefix", "slice", "words", "counts"]
    held = []
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
        if sum(map(len, held)) >= at_once:
            head, run, then, known, counts = _merged(pa.concat_tables(held))
            # the last stripe may go on in the next batch
            last = len(head) - 1
            own = run == last
            yield from whole(head.slice(0, last), run[~own], then[~own], known, counts[~own])
            part = _packed(offsets(head.slice(last), run[own] - last), known.take(pa.array(then[own])), counts[own])
            held = [pa.Table.from_arrays([*(head.slice(last).column(c) for c in names[:3]), *part], names=names)]
    if held:
        yield from whole(*_merged(pa.concat_tables(held)))


def stripes(docs: DataFrame, sizes: tuple[int, ...], frequent: DataFrame, slices: dict[str, int], least: int = LEAST) -> DataFrame:
    """(lang, prefix, words, phrase, a): what merged stripes of prefixes of `sizes` words count `least` times or more.

    frequent: (lang, phrase), all runs of sizes[0] words that occur so often. `words` are those of the phrase.
    """
    spark = docs.sparkSession
    shared, size = spark.sparkContext.broadcast((frequent_filter(frequent), slices)), BLOCK

    def count(batches: Iterator) -> Iterator:
        for lang, text in _blocks(batches, size):
            for table in block_stripes(lang, text, sizes, *shared.value):
                yield from table.to_batches(max_chunksize=20_000)

    key = ["lang", "prefix", "slice"]
    with arrow_batches(spark, 1024):
        parts = docs.select("lang", "text").mapInArrow(count, PART)
        dealt = parts.repartition(*key).sortWithinPartitions(*key)
        whole = materialize(dealt.mapInArrow(partial(merge_stripes, least), STRIPE), f"stripes{sizes[0]}")
    one = whole.select("lang", "prefix", F.explode(F.arrays_zip("words", "counts")).alias("e"))
    length = F.length("prefix") - F.length(F.replace("prefix", F.lit(" "))) + 2
    return one.select("lang", "prefix", length.alias("words"), F.concat_ws(" ", "prefix", "e.words").alias("phrase"), F.col("e.counts").alias("a"))


def phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n); (lang, phrase, f) of phrases of 1 to 3 words; (lang, phrase, words, a, longer) of the candidates.

    f and a are `least` or more. longer: the largest count of a phrase with one word more that holds the candidate.
    """
    spark = docs.sparkSession
    with arrow_batches(spark, 1024):
        found = docs.select("lang", "text").mapInArrow(partial(_count_words, BLOCK), "lang string, phrase string, f long")
        found = found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(f"f >= {least} OR phrase IS NULL")
        found = materialize(found, "words")
    # the stripe of the prefix without words, and its sum
    sizes, words = found.filter("phrase IS NULL").select("lang", F.col("f").alias("n")), found.filter("phrase IS NOT NULL")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # a word with a SLICES-th of all words or more: at most SLICES rows
    share = F.ceil(F.col("f").cast("double") * SLICES / max(total, 1)).cast("long")
    heavy = words.filter(F.col("f").cast("double") * SLICES >= total).select("phrase", share.alias("slices"))
    slices = {r.phrase: r.slices for r in heavy.groupBy("phrase").agg(F.max("slices").alias("slices")).collect()}
    two = stripes(docs, (1,), words.select("lang", "phrase"), slices, least)
    more = stripes(docs, tuple(range(2, LONGEST)), two.select("lang", "phrase"), slices, least)
    known = two.unionByName(more)
    totals = words.select("lang", "phrase", "f").unionByName(known.filter(F.col("words") < LONGEST).select("lang", "phrase", F.col("a").alias("f")))
    # without its last word: the prefix of its stripe; without its first: what is behind the first blank
    tail = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    holders = known.filter("words > 2").select("lang", F.explode(F.array("prefix", tail)).alias("phrase"), "a")
    largest = holders.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return sizes, totals, known.drop("prefix").join(largest, ["lang", "phrase"], "left")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best `top` phrases of each language."""
    sizes, totals, candidates = phrases(docs, least)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    kept = candidates.filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * SUBSUMED)).drop("longer")
    kept = materialize(kept, "candidates")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = kept.select("lang", "phrase", "a", "words", cut).withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    cuts = cuts.join(totals.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(totals.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # `div` of decimals is whole and exact
    cuts = cuts.withColumn("score", F.expr(f"(CAST(a AS DECIMAL(28, 0)) * {SCALE}BD) div (CAST(l AS DECIMAL(28, 0)) + CAST(r AS DECIMAL(28, 0)))"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    scored = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    return _ranked(scored, top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language; those of SALTS parts are taken first."""
    order: list[Column] = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("salt")
