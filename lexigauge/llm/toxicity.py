"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of 3, 4 and 5 characters of its lower-cased text, hashed
into BUCKETS. A feature counts r / sqrt(number of features), where r is the log of how much oftener
toxic texts have it than others. On these a logistic regression is learned by AdaGrad in SHARDS
shards whose weights are averaged after each round. The model has a fixed size.

Learning takes at most MAX_PER_CLASS labelled rows of each class (smallest hash of the doc_id).
Scoring takes every whole text. A null text counts as empty; without features the score is that of
the intercept. A document with several labels counts as toxic if one of them says so; null labels
and ids are no labels. With labels of one class or none, all scores are 1, 0 or 0.5. Repeated rows
are scored each; the columns `score` and `predicted` are replaced if they exist.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import arrow_rows, arrow_schema, small_batches, with_fields

SIZES = (3, 4, 5)
BITS = 18
BUCKETS = 1 << BITS
MAX_PER_CLASS = 4000
SHARDS = 4
ROUNDS = 3
EPOCHS = 3
RATE, DECAY = 0.2, 1e-4


def features(text: str, seen: np.ndarray) -> np.ndarray:
    """The buckets of a text's n-grams, each once. `seen`: BUCKETS false flags, left as they were."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, SIZES[-1] + 1):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in SIZES:
            seen[h >> np.uint64(64 - BITS)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


@dataclass
class Model:
    """weights: of each bucket, with its ratio multiplied in."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str, seen: np.ndarray) -> float:
        x = features(text, seen)
        z = float(self.weights[x].sum()) / np.sqrt(max(len(x), 1)) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """(text, toxic, shard): a bounded sample of the labelled texts that are not held out."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg((F.max(F.col("toxic").cast("int")) > 0).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("toxic").orderBy(*order).limit(max_per_class).union(known.filter("not toxic").orderBy(*order).limit(max_per_class))
    # at most 2 * max_per_class rows, so their broadcast is bounded
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    # a document that comes several times is learned once
    one = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return one.select("text", F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int").alias("shard"), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Model:
    spark = docs.sparkSession
    rows = materialize(training_rows(docs, labels, max_per_class), "training")

    def count(pdf):
        import pandas as pd

        seen, out = np.zeros(BUCKETS, bool), np.zeros((2, BUCKETS), np.int32)
        for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
            out[toxic][features(text, seen)] += 1
        return pd.DataFrame({"n0": [(pdf["toxic"] == 0).sum()], "n1": [(pdf["toxic"] == 1).sum()], "c0": [out[0].tobytes()], "c1": [out[1].tobytes()]})

    # SHARDS rows of fixed size
    parts = rows.groupBy("shard").applyInPandas(count, "n0 long, n1 long, c0 binary, c1 binary").collect()
    n = [sum(p.n0 for p in parts), sum(p.n1 for p in parts)]
    if not all(n):
        return Model(np.zeros(BUCKETS), 0.0 if n[0] == n[1] else 30.0 if n[1] else -30.0)
    c0, c1 = (sum(np.frombuffer(p[c], np.int32) for p in parts) + 1.0 for c in ("c0", "c1"))
    ratio = np.log((c1 / (n[1] + 2)) / (c0 / (n[0] + 2)))
    weights, intercept = np.zeros(BUCKETS), 0.0
    for k in range(ROUNDS):
        start = spark.sparkContext.broadcast((ratio, weights, intercept))
        learned = rows.groupBy("shard").applyInPandas(_learner(start, k), "weights binary, intercept double").collect()
        weights = np.mean([np.frombuffer(p.weights, np.float64) for p in learned], axis=0)
        intercept = float(np.mean([p.intercept for p in learned]))
        start.unpersist()
    return Model(weights * ratio, intercept)


def _learner(start, k: int):
    def learn(pdf):
        import pandas as pd

        ratio, weights, b = start.value
        w, squares, seen = weights.copy(), np.full(BUCKETS, 1e-8), np.zeros(BUCKETS, bool)
        pdf = pdf.sort_values("doc_id")
        rows = [(features(t, seen).astype(np.int32), y) for t, y in zip(pdf["text"], pdf["toxic"], strict=True)]
        rng = np.random.default_rng(k)
        for _ in range(EPOCHS):
            for i in rng.permutation(len(rows)):
                x, y = rows[i]
                v = ratio[x] / np.sqrt(max(len(x), 1))
                off = 1 / (1 + np.exp(-np.clip(w[x] @ v + b, -30, 30))) - y
                g = off * v + DECAY * w[x]
                squares[x] += g * g
                w[x] -= RATE * g / np.sqrt(squares[x])
                b -= 0.01 * off
        return pd.DataFrame({"weights": [w.tobytes()], "intercept": [b]})

    return learn


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `score` (0 to 1, higher: likelier toxic) and `predicted` (1 from 0.5 on)."""
    small_batches(docs.sparkSession)
    schema = with_fields(docs, ("score", T.DoubleType()), ("predicted", T.IntegerType()))
    fields = arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        seen = np.zeros(BUCKETS, bool)
        for batch in batches:
            model = shared.value
            found = np.array([model.score(t or "", seen) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], np.float64)
            yield arrow_rows(batch, fields, score=found, predicted=(found >= 0.5).astype(np.int32))

    return docs.mapInArrow(run, schema)
