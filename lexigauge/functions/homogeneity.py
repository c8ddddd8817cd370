"""Similarity of adjacent sentences by the multiset of their characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of the table of character counts that is made at once; more sentences are taken in turns.
_CELLS = 1 << 22


def _bytes_of(char: Column, text: Column) -> Column:
    """Bytes all occurrences of a character take; sizes in bytes are known without a scan."""
    return F.octet_length(text) - F.octet_length(F.replace(text, char, F.lit("")))


#: Characters of a pair of sentences up to which each of their characters is looked for in both.
_SHORT = 4096


def _histogram(text: Column) -> Column:
    """Each character with its number, in order: run lengths of the sorted characters."""
    ordered = F.array_join(F.sort_array(F.split(text, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*+"), F.lit(0))
    return F.transform(runs, lambda r: F.struct(F.substring(r, 1, 1).alias("char"), F.length(r).cast("bigint").alias("n")))


def _shared_of_sorted(a: Column, b: Column) -> Column:
    """|A ∩ B| by two histograms put together in order, where equal characters meet."""
    both = F.sort_array(F.concat(_histogram(a), _histogram(b)))

    def met(both: Column) -> Column:
        pairs = F.greatest(F.size(both) - 1, F.lit(0))
        same = F.zip_with(
            F.slice(both, F.lit(1), pairs),
            F.slice(both, F.lit(2), pairs),
            lambda x, y: F.when(x["char"] == y["char"], F.least(x["n"], y["n"])).otherwise(F.lit(0).cast("bigint")),
        )
        return F.aggregate(same, F.lit(0).cast("bigint"), lambda total, n: total + n)

    return F.get(F.transform(F.array(both), met), F.lit(0))


def _shared_by_replacing(a: Column, b: Column) -> Column:
    """|A ∩ B| character by character; as many passes over both as there are different characters."""
    return F.aggregate(
        F.array_distinct(F.split(a, "")),
        F.lit(0).cast("bigint"),
        lambda total, char: total
        + F.call_function(
            "div", F.least(_bytes_of(char, a), _bytes_of(char, b)), F.octet_length(char)
        ),
    )


def multiset_cosine(a: Column, b: Column) -> Column:
    """|A ∩ B| / sqrt(|A| |B|) over character multisets.

    Long sentences are sorted, which is linear in all but the sort; short ones are faster without.
    """
    short = F.octet_length(a) + F.octet_length(b) <= _SHORT
    shared = F.when(short, _shared_by_replacing(a, b)).otherwise(_shared_of_sorted(a, b))
    sizes = F.length(a).cast("double") * F.length(b).cast("double")
    return F.try_divide(shared.cast("double"), F.sqrt(sizes))


def adjacent_similarities(sents: Column) -> Column:
    """Array of similarities, one per pair of neighbouring sentences of a text.

    The pairs are formed inside the row, so no shuffle or window is needed.
    """
    pairs = F.greatest(F.size(sents) - 1, F.lit(0))
    return F.zip_with(F.slice(sents, F.lit(1), pairs), F.slice(sents, F.lit(2), pairs), multiset_cosine)


def _batch_similarities(sents):
    """Similarities of neighbours in an Arrow array of lists of sentences, as an array of lists.

    Counts of characters are rows of a matrix, one per sentence, over the characters that occur; the sum of the
    lesser counts of two rows is what the sentences share.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ends = np.cumsum(pc.list_value_length(sents).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    flat = sents.flatten()
    sizes = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    shared = np.zeros(max(len(flat) - 1, 0))
    at, upto = 0, np.cumsum(sizes)
    while at < len(flat) - 1:
        # some sentences with as many characters as cells, at least a pair; the last is the first of the next turn
        before = upto[at] - sizes[at]
        stop = min(max(int(np.searchsorted(upto, before + _CELLS // 64, "right")), at + 2), len(flat))
        together = pa.ListArray.from_arrays(pa.array([0, stop - at], pa.int32()), flat.slice(at, stop - at))
        codes = np.frombuffer(pc.binary_join(together, "")[0].as_py().encode("utf-32-le"), "<u4")
        occurs = np.zeros(int(codes.max(initial=0)) + 1, bool)
        occurs[codes] = True
        kinds = max(int(occurs.sum()), 1)
        places = (np.cumsum(occurs) - 1)[codes]
        of = np.repeat(np.arange(stop - at), sizes[at:stop])
        step = max(_CELLS // kinds, 2)
        for low in range(0, stop - at - 1, step - 1):
            high = min(low + step, stop - at)
            x, y = np.searchsorted(of, [low, high])
            counts = np.bincount((of[x:y] - low) * kinds + places[x:y], minlength=(high - low) * kinds).reshape(high - low, -1)
            shared[at + low : at + high - 1] = np.minimum(counts[1:], counts[:-1]).sum(axis=1)
        at = stop - 1
    product = sizes[1:].astype(float) * sizes[:-1]
    alike = np.divide(shared, np.sqrt(product), out=np.full(len(shared), np.nan), where=product > 0)
    first = np.ones(len(flat) + 1, bool)
    first[:-1] = False
    first[ends] = True  # a pair that ends with the first sentence of a text is none
    inner = pa.array(alike[~first[1 : len(flat)]], from_pandas=True)
    pairs = np.maximum(np.diff(ends, prepend=0) - 1, 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pairs)]).astype(np.int32)), inner)


def adjacent_similarities_in_batches(sents: Column) -> Column:
    """The same as `adjacent_similarities`, computed for an Arrow batch of texts at a time."""
    return F.arrow_udf(_batch_similarities, "array<double>")(sents)
