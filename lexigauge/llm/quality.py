"""Quality rules: counts of a text, and its perplexity under a modified Kneser-Ney model with bands for each language.

The model's grams are runs of ORDER characters of a text's words with one blank between them. Spark counts them over all
documents, by language; the lower orders count in how many longer grams a gram is the end. Each order interpolates
with the one below by three discounts from the counts of counts, down to equal shares of the characters known and one unknown.
Logarithms are whole millionths, so sums don't depend on the order of rows.

No text is scored by a model that has read it, as such a model knows its rarest runs by heart: texts are dealt into FOLDS by their
hash, so that copies stay together, and a fold is scored by the model of the next one.

A model is two sorted arrays of 64-bit hashes for each language: grams with their log probabilities, contexts with their
log back-off weights. It is broadcast if it has at most MODEL_ENTRIES entries, counted before; a larger one
is joined to the grams of the documents instead, with the same result. Characters, not words, as the distinct word
pairs of a corpus grow almost as the corpus does, and a model of them knows each copied text by heart.

A document is rejected if it has fewer than 10 words or over a fifth of them in repeated 5-word windows (the base), or if
its log perplexity lies outside its language's band, lower or higher. The band's middle is the language's median; it reaches WIDTH
deviations to either side, whose square is that of the median absolute deviation (FLOOR at least) plus that of SPREAD over
the grams of the document: a mean of few grams varies more. Medians are those of all documents of the language that
the base keeps, from counts of thousandths.

Null and empty texts have no words and fail the base; a null language is `und`. Repeated rows are judged each, with equal
results. A text of any length is read in slices; the worker holds some 30 bytes a word of it. A
perplexity on a band's edge is kept. An empty table gives no rows. The text column is not returned; columns of the
names of MEASURES and of VERDICT are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_within, materialize
from .common import arrow_batches, arrow_rows, arrow_schema, free_name

ORDER = 5
#: Bytes of a character in a gram: a code point needs 21 bits.
WIDE = 3
#: Bits of a code point in a gram that is counted as one number: 64 bits hold ORDER of them.
LOW = 12
UNIT = 1_000_000
FOLDS = 2
MODEL_ENTRIES = 1 << 23
#: Rows of a language or a model each that are broadcast; more are joined by a shuffle.
MODELS = 100_000
#: Characters a task counts at once, and scores at once.
COUNT_AT_ONCE, SCORE_AT_ONCE = 4_000_000, 1_000_000
#: Bytes of a text that are split into words at once.
SLICE = 4_000_000
WIDTH, FLOOR, SPREAD = 6, 0.02, 1.0
LEAST_WORDS, REPEATED_PERCENT = 10, 20
SYMBOLS = "#*$%&|<>"
#: The columns added: counts of the base, the sum of the log probabilities, and the grams it sums.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_p", "n_grams")
VERDICT = ("log_perplexity", "perplexity", "base_failed", "kept")

_IS_SYMBOL = np.zeros(128, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, cut at ASCII white space."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE) + 1 or len(text)
        yield text[at:end].split()
        at = end


def codes(words: list[bytes]) -> np.ndarray:
    """The code points of words, a blank behind each."""
    return np.frombuffer((b" ".join(words) + b" ").decode().encode("utf-32-le"), np.uint32) if words else np.zeros(0, np.uint32)


def hashes(points: np.ndarray, size: int) -> np.ndarray:
    """The hashes of all runs of `size` code points."""
    h = np.full(max(len(points) - size + 1, 0), size + 1, np.uint64)
    for i in range(size):
        h = (h ^ points[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def repeated_words(ids: np.ndarray) -> int:
    """How many words lie in 5-word windows that occur twice or more. Windows are told apart exactly, by ranks of their parts."""
    if len(ids) < 6:
        return 0
    size = int(ids.max()) + 1
    pairs, rank = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
    if len(pairs) == len(rank):
        return 0
    _, four = np.unique(rank[:-2] * len(pairs) + rank[2:], return_inverse=True)
    _, window, n = np.unique(four[:-1] * size + ids[4:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[window] > 1)
    covered = np.zeros(len(ids) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + 5, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            n += line in seen
            seen.add(line)
    return n


class _Held:
    """Sequences of code points of several texts, hashed together."""

    def __init__(self) -> None:
        self.parts, self.groups, self.rows, self.size = [], [], [], 0

    def add(self, points: np.ndarray, group, row: int = 0) -> None:
        self.parts.append(points)
        self.groups.append(group)
        self.rows.append(row)
        self.size += len(points)

    def grams(self) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, list[int], np.ndarray]]:
        """(group, points, places and hashes of its grams, rows, where each row's grams start)."""
        points = np.concatenate(self.parts)
        h = hashes(points, ORDER)
        starts = np.append(0, np.cumsum([len(p) for p in self.parts]))
        for group in dict.fromkeys(self.groups):
            own = [i for i, g in enumerate(self.groups) if g == group]
            spans = [np.arange(starts[i], starts[i + 1] - ORDER + 1) for i in own]
            at = np.concatenate(spans)
            firsts = np.append(0, np.cumsum([len(s) for s in spans]))[:-1]
            yield group, points, at, h[at], [self.rows[i] for i in own], firsts


def _sequences(text: bytes) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The words of each slice, and their code points behind the last ORDER - 1 of the slice before (blanks at first)."""
    last = np.full(ORDER - 1, 32, np.uint32)
    for words in slices(text):
        points = np.concatenate([last, codes(words)])
        last = points[-(ORDER - 1) :]
        yield words, points


def _key(lang: str | None, text: bytes, folds: int, ahead: int) -> str:
    """The model of a text: the fold `ahead` of its own, and its language."""
    return f"{(zlib.crc32(text) + ahead) % folds}:{'und' if lang is None else lang}"


def _texts(batch, folds: int, ahead: int):
    """(model, text) of each row."""
    import pyarrow as pa

    texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
    langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
    for lang, text in zip(langs, texts, strict=True):
        text = text.as_py() or b""
        yield _key(lang, text, folds, ahead), text


def _packed(grams: np.ndarray):
    """Grams, a row of code points each, as bytes, WIDE for each character."""
    import pyarrow as pa

    data = np.ascontiguousarray(grams.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :WIDE].copy()
    offsets = np.arange(len(grams) + 1, dtype=np.int32) * (ORDER * WIDE)
    return pa.BinaryArray.from_buffers(pa.binary(), len(grams), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _distinct(points: np.ndarray, at: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grams at `at` and how often each occurs.

    Grams of low code points are sorted as numbers, the others by their hashes; a gram is one or the other.
    """
    high = np.append(0, np.cumsum(points >> LOW))
    low = high[at + ORDER] == high[at]
    number = np.zeros(int(low.sum()), np.uint64)
    for i in range(ORDER):
        number = (number << np.uint64(LOW)) | points[at[low] + i]
    found, n = np.unique(number, return_counts=True)
    shifts = np.arange(ORDER - 1, -1, -1, dtype=np.uint64) * np.uint64(LOW)
    yield (found[:, None] >> shifts) & np.uint64((1 << LOW) - 1), n
    rest = at[~low]
    if len(rest):
        _, first, n = np.unique(h[~low], return_index=True, return_counts=True)
        yield points[rest[first][:, None] + np.arange(ORDER)], n


def _counted(held: _Held) -> Iterator:
    import pyarrow as pa

    for model, points, at, h, _, _ in held.grams():
        for grams, n in _distinct(points, at, h):
            for a in range(0, len(grams), 100_000):
                some = _packed(grams[a : a + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array([model] * len(some)), some, pa.array(n[a : a + 100_000].astype(np.int64))], names=["model", "gram", "n"])


def _count(folds: int, batches: Iterator) -> Iterator:
    held = _Held()
    for batch in batches:
        for model, text in _texts(batch, folds, 0):
            for _, points in _sequences(text):
                held.add(points, model)
                if held.size >= COUNT_AT_ONCE:
                    yield from _counted(held)
                    held = _Held()
    if held.size:
        yield from _counted(held)


def gram_counts(docs: DataFrame, folds: int) -> list[DataFrame]:
    """(model, gram, c) of orders 1 to ORDER: occurrences of the longest, for the others the longer grams they end."""
    with arrow_batches(docs.sparkSession, 256):
        found = docs.select("lang", "text").mapInArrow(partial(_count, folds), "model string, gram binary, n long")
        out = [materialize(found.groupBy("model", "gram").agg(F.sum("n").alias("c")), f"grams{ORDER}")]
    for k in range(ORDER - 1, 0, -1):
        ends = out[0].groupBy("model", F.expr(f"substring(gram, {WIDE + 1})").alias("gram")).agg(F.count("*").alias("c"))
        out.insert(0, materialize(ends, f"grams{k}"))
    return out


def discounts(counts: DataFrame) -> DataFrame:
    """(model, d1, d2, d3) of one order from its counts of counts, written; half the count where these give none."""
    n = [F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.expr("n1 / (n1 + 2.0D * n2)")

    def d(i: int) -> Column:
        fair = F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
        usable = F.least(*(F.col(f"n{j}") for j in (1, 2, 3, 4))) > 0
        return F.when(usable, F.when((fair > 0) & (fair <= i), fair)).alias(f"d{i}")

    found = counts.groupBy("model").agg(*n)
    # the divisions are only looked at where all counts are above 0
    safe = found.select("model", *(F.when(F.least("n1", "n2", "n3", "n4") > 0, F.col(f"n{i}")).alias(f"n{i}") for i in (1, 2, 3, 4)))
    found = safe.select("model", *(F.coalesce(d(i), F.lit(i / 2)).alias(f"d{i}") for i in (1, 2, 3)))
    # a row a model: broadcast, as a shuffle by the model would deal all grams to as many tasks
    return broadcast_within(materialize(found, "discounts"), MODELS)


@dataclass
class Model:
    """(model, gram, log_p) and (model, gram, log_b) in millionths, and the number of folds they were counted in."""

    probs: DataFrame
    weights: DataFrame
    folds: int = 1


def fit(docs: DataFrame, folds: int = 1) -> Model:
    """A model of each fold and language of `docs`, written."""
    counts = gram_counts(docs, folds)
    millionths = lambda c: F.round(F.log(c) * UNIT).cast("int")
    known = counts[0].groupBy("model").agg((1.0 / (F.count("*") + 1)).alias("p"))
    lower = materialize(known.select("model", F.lit(b"").alias("gram"), "p"), "p0")
    probs, weights = [lower], []
    for k, own in enumerate(counts, 1):
        grams = own.join(discounts(own), "model").withColumn("context", F.expr(f"substring(gram, 1, {WIDE * (k - 1)})"))
        grams = grams.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        # the discounts taken from a context's grams go to the order below
        contexts = grams.groupBy("model", "context").agg(F.sum("c").alias("total"), *(F.count(t).alias(f"m{i}") for i, t in ((1, F.when(F.col("c") == 1, 1)), (2, F.when(F.col("c") == 2, 1)), (3, F.when(F.col("c") > 2, 1)))), *(F.max(f"d{i}").alias(f"d{i}") for i in (1, 2, 3)))
        contexts = contexts.select("model", "context", "total", F.expr("(d1 * m1 + d2 * m2 + d3 * m3) / total").alias("b"))
        below = lower.select("model", F.col("gram").alias("ends"), F.col("p").alias("below"))
        grams = grams.select("model", "gram", "c", "d", "context").join(contexts, ["model", "context"]).withColumn("ends", F.expr(f"substring(gram, {WIDE + 1})"))
        p = F.expr("(c - d) / total + b * below")
        lower = materialize(grams.join(below, ["model", "ends"]).select("model", "gram", p.alias("p")), f"p{k}")
        probs.append(lower)
        weights.append(contexts.select("model", F.col("context").alias("gram"), millionths(F.col("b")).alias("log_b")))
    all_p, all_b = probs[0], weights[0]
    for more in probs[1:]:
        all_p = all_p.unionByName(more)
    for more in weights[1:]:
        all_b = all_b.unionByName(more)
    return Model(materialize(all_p.select("model", "gram", millionths(F.col("p")).alias("log_p")), "probs"), materialize(all_b, "weights"), folds)


class Arrays:
    """Sorted hashes and the value of each; hashes are even, so their first bits tell about where to look."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(len(keys), 1).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        # behind all keys stands one that ends each search
        self.keys, self.values = np.append(keys, ~np.uint64(0)), np.append(values, np.int32(0)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of hashes, and which of them are known."""
        at = self.starts[h >> self.shift]
        found = self.keys[at]
        left = np.flatnonzero(found < h)
        while len(left):
            at[left] += 1
            found[left] = self.keys[at[left]]
            left = left[found[left] < h[left]]
        return self.values[at], (found == h) & (at < len(self.keys) - 1)


def sorted_arrays(table: DataFrame, value: str) -> dict[str, Arrays]:
    """The arrays of each model, put together of sorted ranges of hashes."""

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            grams = batch.column(1).to_pylist()
            sizes = np.array([len(g) // WIDE for g in grams])
            h = np.zeros(len(grams), np.uint64)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                three = np.frombuffer(b"".join(grams[i] for i in own), np.uint8).reshape(len(own), size, WIDE)
                points = three.astype(np.uint32) @ np.array([1, 1 << 8, 1 << 16], np.uint32) if size else np.zeros((len(own), 0), np.uint32)
                h[own] = _hash_rows(points)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((h >> np.uint64(58)).astype(np.int32)), pa.array(h.view(np.int64)), batch.column(2)], names=["model", "range", "h", "v"])

    def collect(pdf):
        import pandas as pd

        h, v = pdf["h"].to_numpy(np.int64).view(np.uint64), pdf["v"].to_numpy(np.int32)
        order = np.argsort(h, kind="stable")
        return pd.DataFrame({"model": pdf["model"][:1].to_numpy(), "range": pdf["range"][:1].to_numpy(), "h": [h[order].tobytes()], "v": [v[order].tobytes()]})

    rows = table.select("model", "gram", value).mapInArrow(hashed, "model string, range int, h long, v int")
    parts: dict[str, dict] = {}
    # MODEL_ENTRIES entries in all
    for r in rows.groupBy("model", "range").applyInPandas(collect, "model string, range int, h binary, v binary").toLocalIterator():
        parts.setdefault(r.model, {})[r.range] = (np.frombuffer(r.h, np.uint64), np.frombuffer(r.v, np.int32))
    return {model: Arrays(*(np.concatenate([own[k][i] for k in sorted(own)]) for i in (0, 1))) for model, own in parts.items()}


def _hash_rows(points: np.ndarray) -> np.ndarray:
    """The hash of each row of code points."""
    h = np.full(len(points), points.shape[1] + 1, np.uint64)
    for i in range(points.shape[1]):
        h = (h ^ points[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def log_probabilities(h: np.ndarray, points: np.ndarray, at: np.ndarray, probs: Arrays, weights: Arrays) -> np.ndarray:
    """Of the grams at `at`: the longest known end of each, with the weights of the contexts backed off from."""
    out, known = probs.find(h)
    left = np.flatnonzero(~known)
    if len(left):
        out[left] = 0
        grams = points[at[left][:, None] + np.arange(ORDER)]
        for size in range(ORDER, 0, -1):
            value, found = weights.find(_hash_rows(grams[:, ORDER - size : ORDER - 1]))
            out[left] += np.where(found, value, 0)
            value, found = probs.find(_hash_rows(grams[:, ORDER - size + 1 :]))
            out[left[found]] += value[found]
            left, grams = left[~found], grams[~found]
    return out


def _measure(arrays, folds: int):
    """Arrow batches without texts, with MEASURES; without arrays no log_p."""

    def run(batches: Iterator, fields: list) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            got = {m: np.zeros(n, np.int64) for m in MEASURES}
            known = np.ones(n, bool)
            held = _Held()

            def flush() -> None:
                for model, points, at, h, rows, firsts in held.grams():
                    if arrays is None or model not in arrays.value[0]:
                        known[rows] = False
                        continue
                    values = np.append(log_probabilities(h, points, at, *(part[model] for part in arrays.value)), 0)
                    np.add.at(got["log_p"], rows, np.add.reduceat(values, firsts))

            for i, (model, text) in enumerate(_texts(batch, folds, 1)):
                ids, seen = [], {}
                for words, points in _sequences(text):
                    if not words:
                        continue
                    got["word_chars"][i] += len(points) - (ORDER - 1) - len(words)
                    plain = points[ORDER - 1 :]
                    got["n_symbols"][i] += _IS_SYMBOL[plain[plain < 128]].sum()
                    got["n_grams"][i] += len(points) - ORDER + 1
                    ids.append(np.array([seen.setdefault(w, len(seen)) for w in words], np.int64))
                    held.add(points, model, i)
                    if held.size >= SCORE_AT_ONCE:
                        flush()
                        held = _Held()
                if ids:
                    got["n_words"][i] = sum(map(len, ids))
                    got["n_repeat_words"][i] = repeated_words(np.concatenate(ids))
                    got["n_dup_lines"][i] = repeated_lines(text)
            if held.size:
                flush()
            got["log_p"] = pa.array(got["log_p"], mask=~known)
            yield arrow_rows(batch, fields, **got)

    return run


def _schema(docs: DataFrame) -> T.StructType:
    gone = {"text", *MEASURES, *VERDICT}
    return T.StructType([*(f for f in docs.schema.fields if f.name not in gone), *(T.StructField(m, T.LongType()) for m in MEASURES)])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` (lang, text, ...) without text, with MEASURES, written. log_p is null where there is no model."""
    spark = docs.sparkSession
    schema = _schema(docs)
    fields = arrow_schema(schema)
    entries = model.probs.count() + model.weights.count()
    if entries > MODEL_ENTRIES:
        return _score_by_joins(docs, model)
    shared = spark.sparkContext.broadcast((sorted_arrays(model.probs, "log_p"), sorted_arrays(model.weights, "log_b")))
    run = _measure(shared, model.folds)
    with arrow_batches(spark, 256):
        return materialize(docs.mapInArrow(lambda batches: run(batches, fields), schema), "measured")


def _score_by_joins(docs: DataFrame, model: Model) -> DataFrame:
    """The same with the grams of each document joined to the model, for models too large to be broadcast."""
    spark, folds = docs.sparkSession, model.folds
    # a row's number must stay when it is read again, so the rows are written
    numbered = materialize(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("id")), "numbered")

    def grams(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id")).to_pylist()
            for i, (key, text) in zip(ids, _texts(batch, folds, 1), strict=True):
                for _, points in _sequences(text):
                    held = _Held()
                    held.add(points, key)
                    for part in _counted(held):
                        yield pa.RecordBatch.from_arrays([pa.array([i] * part.num_rows), *part.columns], names=["id", "model", "gram", "n"])

    with arrow_batches(spark, 256):
        found = numbered.select("id", "row.lang", "row.text").mapInArrow(grams, "id long, model string, gram binary, n long")
        found = materialize(found, "document_grams")
        values = _costs(found.select("model", "gram").distinct(), ORDER, model.probs, model.weights)
        sums = found.join(values, ["model", "gram"]).groupBy("id").agg(F.sum(F.col("n") * F.col("v")).alias("sum"))
        schema = _schema(docs)
        fields = arrow_schema(schema)
        run = _measure(None, folds)
        number = free_name(docs, "number")
        measured = T.StructType([*schema.fields, T.StructField(number, T.LongType())])
        inner = docs.schema.names

        def measure(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                row = batch.column(0)
                own = pa.RecordBatch.from_arrays([row.field(i) for i in range(len(inner))], names=inner)
                (out,) = run(iter([own]), fields)
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(1)], names=[*out.schema.names, number])

        rows = materialize(numbered.mapInArrow(measure, measured), "measured_rows")
    rows = rows.select(F.struct(*schema.names).alias("row"), F.col(number).alias("id"))
    joined = rows.join(sums, "id", "left")
    # a text without words has no grams: its sum is 0, as in the other way
    log_p = F.when(F.col("row.n_grams") == 0, F.lit(0)).otherwise(F.col("sum")).cast("long")
    return materialize(joined.select(*(log_p.alias(c) if c == "log_p" else F.col("row")[c].alias(c) for c in schema.names)), "measured")


def _costs(grams: DataFrame, size: int, probs: DataFrame, weights: DataFrame) -> DataFrame:
    """(model, gram, v) of distinct grams of `size` characters: the log probability, backed off where it is not known."""
    found = materialize(grams.join(probs, ["model", "gram"], "left"), f"costs{size}")
    known = found.filter("log_p IS NOT NULL").select("model", "gram", F.col("log_p").cast("long").alias("v"))
    if size == 0:
        return known
    left = found.filter("log_p IS NULL").select("model", "gram", F.expr(f"substring(gram, {WIDE + 1})").alias("ends"), F.expr(f"substring(gram, 1, {WIDE * (size - 1)})").alias("context"))
    lower = _costs(left.select("model", F.col("ends").alias("gram")).distinct(), size - 1, probs, weights)
    left = left.join(lower.withColumnRenamed("gram", "ends"), ["model", "ends"])
    left = left.join(weights.withColumnRenamed("gram", "context"), ["model", "context"], "left")
    return known.unionByName(left.select("model", "gram", (F.col("v") + F.coalesce("log_b", F.lit(0))).alias("v")))


def bands(measured: DataFrame) -> DataFrame:
    """(lang, middle, deviation) of the log perplexities of each language, in thousandths; the deviation FLOOR at least."""
    # a language has few distinct thousandths, whatever its number of documents
    counted = measured.groupBy("lang", F.round(F.col("log_perplexity") * 1000).cast("long").alias("at")).count()
    middle = _median(counted, "at").withColumnRenamed("at", "middle")
    off = counted.join(middle, "lang").groupBy("lang", F.abs(F.col("at") - F.col("middle")).alias("off")).agg(F.sum("count").alias("count"))
    deviation = F.greatest(F.col("off"), F.lit(int(FLOOR * 1000))).alias("deviation")
    return middle.join(_median(off, "off"), "lang").select("lang", "middle", deviation)


def _median(counted: DataFrame, value: str) -> DataFrame:
    """(lang, value): the lower median of counted values."""
    of_lang = Window.partitionBy("lang")
    up_to = F.sum("count").over(of_lang.orderBy(value))
    summed = counted.select("lang", value, up_to.alias("up_to"), F.sum("count").over(of_lang).alias("all"))
    return summed.filter(F.col("up_to") * 2 >= F.col("all")).groupBy("lang").agg(F.min(value).alias(value))


def judge(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """`docs` (lang, text, ...) without text, with MEASURES, log_perplexity, perplexity, base_failed, kept.

    The model is that of the other folds of `docs` if none is given. A document without a model is judged by the base.
    """
    measured = score(docs, model or fit(docs, FOLDS))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED_PERCENT)
    log_perplexity = F.try_divide(-F.col("log_p"), F.col("n_grams") * UNIT)
    rows = measured.select(F.struct(*measured.columns).alias("row"), F.coalesce("lang", F.lit("und")).alias("lang"), failed.alias("base_failed"), log_perplexity.alias("log_perplexity"))
    band = bands(rows.filter("NOT base_failed AND log_perplexity IS NOT NULL"))
    band = broadcast_within(materialize(band, "bands"), MODELS)
    reach = WIDTH * F.sqrt(F.pow("deviation", F.lit(2)) + F.try_divide(F.lit((1000 * SPREAD) ** 2), F.col("row.n_grams")))
    outside = F.coalesce(F.abs(F.col("log_perplexity") * 1000 - F.col("middle")) > reach, F.lit(False))
    kept = ~F.col("base_failed") & ~outside
    out = rows.join(band, "lang", "left")
    return out.select("row.*", "log_perplexity", F.exp("log_perplexity").alias("perplexity"), "base_failed", kept.alias("kept"))
