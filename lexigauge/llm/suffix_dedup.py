"""Removal of repeated passages by a hash-compared suffix sort.

A byte is removed if a string of 100 bytes that covers it also starts earlier: in a document with a
smaller doc_id, or earlier in its own. Texts are UTF-8 bytes and matches never cross documents.

Which suffixes can be equal over 100 bytes is told by anchors: every string of 100 bytes has 69 grams
of 32 bytes, and the one with the smallest hash (of equal ones the first) is its anchor. Equal
strings have equal anchors at equal offsets, so only suffixes whose anchor's gram occurs again in the
corpus are compared, in groups of one gram. A record is a run of neighbouring suffixes with one anchor
and the bytes they span. In a group

1. records with equal bytes are one, the first; in the others all is repeated,
2. the suffixes of the different ones are sorted by a merge sort, from runs of one hash on (suffixes
   whose hash no other has can't be repeated and are left out). Two are compared by their common
   extension, which a binary search over prefix polynomial hashes finds in seven steps, and the byte
   behind it. Neighbours that share 100 bytes are verified byte by byte; of each class the first
   stays.

Which grams occur again is kept in bits whose number grows with that of the grams, up to 64 MB (false
hits cost time only). Grams with more than HOT records are spread out: where a task has met the bytes of
a record or string before, at an earlier place, the later is settled there; of the others every string
is a record of its own, grouped by its hash, so neither a gram nor a common string makes a large group.

Rows that share doc_id and text are one document. A null text is empty, a null doc_id comes before all
others. Texts under 100 bytes stay whole. Other columns are kept; the result's columns replace any of
the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import arrow_rows, arrow_schema, carried, small_batches, text_of, with_fields

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1
#: Bits for each gram that occurs again, and how many bits there are at least and at most.
GRAM_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 29
#: Bits of one row of the table that the bits are collected from.
ROW_BITS = 1 << 15
HOT = 50_000
#: Records and strings of hot grams that a task remembers.
REMEMBERED = 1 << 16
#: In place of an offset: the run repeats what its task has met before.
SETTLED = -1
#: Bytes of records that one group of grams should hold.
GROUP_BYTES = 4 << 20
CHUNK = 1 << 20
#: Bytes of short texts that are hashed together.
PACK = 1 << 16
NO_ID = -(1 << 63)

_RNG = np.random.default_rng(7)
#: Two independent hash functions: a value for each byte and an odd base.
_VALUES = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [int(x) * 8 + 5 for x in _RNG.integers(1 << 40, 1 << 60, 2)]
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base & _MASK)
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of any stretch of a buffer from prefix sums of value x base ** position, modulo 2 ** 64."""

    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, local: np.ndarray | None = None, which: int = 0):
        """local: positions to count from, where the buffer is made of several strings."""
        size = CHUNK + 4 * LENGTH
        if which not in self.tables:
            base = _BASES[which]
            self.tables[which] = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
        power, self.inverse = self.tables[which]
        scaled = _VALUES[which][data] * (power[: len(data)] if local is None else power[local])
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(scaled, out=self.sums[1:])

    def all_of(self, n: int) -> np.ndarray:
        """The hash of every stretch of n bytes."""
        count = len(self.sums) - n
        return mixed((self.sums[n:] - self.sums[:-n]) * self.inverse[:count])

    def of(self, a, local, n) -> np.ndarray:
        return (self.sums[a + n] - self.sums[a]) * self.inverse[local]

    def same(self, a, b, a_local, b_local, n) -> np.ndarray:
        return self.of(a, a_local, n) == self.of(b, b_local, n)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first start, number of starts, anchor - first start) of the runs of a stretch of at most CHUNK starts.

    ends: where each of several stretches ends that lie in `data` behind one another; no run spans two.
    """
    grams = Hashes(data).all_of(GRAM)
    low = np.uint64((1 << 24) - 1)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    # minima of all windows from running minima of blocks, forwards and backwards
    blocks = np.full(-(-len(keys) // WINDOW) * WINDOW, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(data) - LENGTH + 1
    at = (np.minimum(back[:count], ahead[WINDOW - 1 : WINDOW - 1 + count]) & low).astype(np.int64)
    if ends is None or len(ends) == 1:
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        number = np.diff(np.append(first, count))
    else:
        whole = np.ones(len(data), bool)
        whole[(ends[:, None] - np.arange(1, LENGTH)).ravel()] = False
        starts = np.flatnonzero(whole[:count])
        at_start = at[starts]
        edge = np.concatenate(([0], np.flatnonzero(at_start[1:] != at_start[:-1]) + 1))
        first, number = starts[edge], np.diff(np.append(edge, len(starts)))
    anchor = at[first]
    return grams[anchor].view(np.int64), first, number, anchor - first


def stretches(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    """(start, bytes): pieces of a text, each string of 100 bytes in just one of them."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    for a in range(0, len(data) - LENGTH + 1, CHUNK):
        yield a, data[a : a + CHUNK + LENGTH - 1]


def packs(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row, start, end): stretches of texts put together, with the row, the start in its text and the end of each."""
    rows, starts, parts, size = [], [], [], 0

    def pack():
        return np.concatenate(parts), np.array(rows), np.array(starts), np.cumsum([len(p) for p in parts])

    for row, text in enumerate(texts):
        for a, data in stretches(text):
            if parts and size + len(data) > PACK:
                yield pack()
                rows, starts, parts, size = [], [], [], 0
            rows.append(row)
            starts.append(a)
            parts.append(data)
            size += len(data)
    if parts:
        yield pack()


def pieces(data: np.ndarray, begin: np.ndarray, lengths: np.ndarray):
    """An Arrow array of the bytes from each `begin` on."""
    import pyarrow as pa

    ends = np.cumsum(lengths)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    raw = data[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], lengths)]
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def merge_sort(data: np.ndarray, at: np.ndarray, local: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes in each segment, and whether each equals the one before it over LENGTH bytes.

    Suffixes whose hash over LENGTH bytes no other of the segment has are left out. Those of one hash are
    a run that is in order from the start (equal suffixes keep their order), so a run moves as its first
    suffix does. All segments are merged at once: in a round, blocks of `width` runs become blocks of
    twice that, and a run's new place is its own plus its rank in the other block.
    """
    hashes = Hashes(data, local)
    whole = mixed(hashes.of(at, local[at], LENGTH) + segment.astype(np.uint64) * np.uint64(_BASES[0] & _MASK))
    together = np.argsort(whole, kind="stable")
    edges = np.append(np.flatnonzero(np.append(True, np.diff(whole[together]) != 0)), len(at))
    run = np.flatnonzero(np.diff(edges) > 1)
    run = run[np.argsort(segment[together[edges[run]]], kind="stable")]
    lead = together[edges[run]]
    n, lead_at, lead_local, lead_segment = len(run), at[lead], local[at[lead]], segment[lead]
    begin = np.flatnonzero(np.append(True, lead_segment[1:] != lead_segment[:-1])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begin, n))
    head, stop = np.repeat(begin, sizes), np.repeat(begin + sizes, sizes)
    order = np.arange(n)

    def extension(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common bytes of the first suffixes of the runs a and b, at most LENGTH."""
        out = np.zeros(len(a), np.int64)
        x, y, x_local, y_local = lead_at[a], lead_at[b], lead_local[a], lead_local[b]
        for step in (64, 32, 16, 8, 4, 2, 1):
            more = np.where(out + step <= LENGTH, out, 0)
            same = (more == out) & hashes.same(x + more, y + more, x_local + more, y_local + more, step)
            out += step * same
        return out

    def before(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether a comes before b; for equal ones `ties`."""
        e = extension(a, b)
        equal = e == LENGTH
        e = np.where(equal, 0, e)
        return np.where(equal, ties, data[lead_at[a] + e] < data[lead_at[b] + e])

    width, place = 1, np.arange(n)
    while width < sizes.max(initial=0):
        # segments of one block are done
        place = place[(stop - head)[place] > width]
        own_head, own_stop = head[place], stop[place]
        block = (place - own_head) // width
        right = block % 2 == 1
        low = np.minimum(own_head + (block ^ 1) * width, own_stop)
        high = np.minimum(low + width, own_stop)
        own = own_head + block * width
        origin, rank_from = np.where(right, low, own), low.copy()
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) // 2
            less = before(order[middle], order[place[active]], right[active])
            low[active[less]] = middle[less] + 1
            high[active[~less]] = middle[~less]
            active = active[low[active] < high[active]]
        moved = order[place]
        order[origin + (place - own) + (low - rank_from)] = moved
        width *= 2
    run = run[order]
    members = np.diff(edges)[run]
    inside = np.arange(members.sum()) - np.repeat(np.cumsum(members) - members, members)
    order = together[np.repeat(edges[run], members) + inside]
    equal = np.zeros(len(order), bool)
    if len(order):
        a, b = order[:-1], order[1:]
        equal[1:] = hashes.same(at[a], at[b], local[at[a]], local[at[b]], LENGTH) & (segment[a] == segment[b])
    return order, equal


def repeated(data: np.ndarray, at: np.ndarray, local: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Whether each suffix is equal over LENGTH bytes to one before it in its segment."""
    order, equal = merge_sort(data, at, local, segment)
    out = np.zeros(len(at), bool)
    again = np.flatnonzero(equal)
    for part in np.array_split(again, max(1, len(again) // 20_000)):
        span = np.arange(LENGTH)
        a, b = data[at[order[part - 1]][:, None] + span], data[at[order[part]][:, None] + span]
        if not (a == b).all():
            return _by_bytes(data, at, segment)
    out[order[again]] = True
    return out


def _by_bytes(data: np.ndarray, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """The same after a collision of hashes: by the bytes themselves."""
    seen, out = set(), np.zeros(len(at), bool)
    for i, (a, s) in enumerate(zip(at.tolist(), segment.tolist(), strict=True)):
        key = (s, data[a : a + LENGTH].tobytes())
        out[i] = key in seen
        seen.add(key)
    return out


def group_repeats(gram, doc, tie, first, number, offset, spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, first start, number of starts) of the runs of repeated suffixes among records of some grams."""
    import pyarrow.compute as pc

    order = np.lexsort((first, tie, doc, gram))
    new = np.append(True, (np.diff(doc[order]) != 0) | (np.diff(tie[order]) != 0) | (np.diff(first[order]) != 0))
    order = order[new]  # a row that comes twice is one document
    codes = pc.dictionary_encode(spans).indices.to_numpy()[order].astype(np.int64)
    key = codes * LENGTH + offset[order]
    _, earliest, which = np.unique(key, return_index=True, return_inverse=True)
    copies = earliest[which] != np.arange(len(order))
    out = [(order[copies], first[order[copies]], number[order[copies]])]
    rest = order[~copies]
    g = gram[rest]
    edge = np.append(True, g[1:] != g[:-1])
    groups = np.cumsum(edge) - 1
    rest = rest[np.bincount(groups)[groups] > 1]
    if len(rest):
        # suffixes in the order of documents within a segment: a gram and the anchor's offset in the suffix
        taken = spans.take(rest)
        ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1]
        raw = np.frombuffer(taken.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        lengths = number[rest] + LENGTH - 1
        begin = np.cumsum(lengths) - lengths
        local = np.arange(len(raw)) - np.repeat(begin, lengths)
        record = np.repeat(np.arange(len(rest)), number[rest])
        step = np.arange(len(record)) - np.repeat(np.cumsum(number[rest]) - number[rest], number[rest])
        edge = np.append(True, gram[rest][1:] != gram[rest][:-1])
        segment = (np.cumsum(edge) - 1)[record] * LENGTH + offset[rest][record] - step
        sort = np.argsort(segment, kind="stable")
        sizes = np.bincount(segment)
        sort = sort[sizes[segment[sort]] > 1]
        if len(sort):
            hit = repeated(raw, begin[record[sort]] + step[sort], local, segment[sort])
            found = np.sort(sort[hit])
            if len(found):
                runs = np.append(True, (np.diff(found) != 1) | (np.diff(record[found]) != 0))
                a = found[runs]
                n = np.diff(np.append(np.flatnonzero(runs), len(found)))
                out.append((rest[record[a]], first[rest[record[a]]] + step[a], n))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _bits(table: DataFrame, n: int) -> np.ndarray:
    """Bits of which each of the n grams of the table sets one, GRAM_BITS a gram as long as there are not over MOST_BITS."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (n * GRAM_BITS - 1).bit_length()))
    bit = F.col("gram").bitwiseAND(F.lit(size - 1))
    at, bit = F.shiftright(bit, ROW_BITS.bit_length() - 1), bit.bitwiseAND(F.lit(ROW_BITS - 1))
    # dealt out first: else each task would send a row of bits for each gram or so
    dealt = table.select(at.alias("at"), bit.alias("bit")).repartition("at")
    out = np.zeros(size // 8, np.uint8).reshape(-1, ROW_BITS // 8)
    for row in dealt.groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        out[row["at"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _has(bits: np.ndarray, gram: np.ndarray) -> np.ndarray:
    at = gram & (len(bits) * 8 - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Met:
    """What a task has seen of hot grams: bytes, and the earliest place (doc, tie, start) that they start at."""

    def __init__(self, most: int):
        self.most, self.places = most, {}

    def earlier(self, key, place: tuple[int, int, int]) -> bool:
        """Whether `key` was met at an earlier place; if not, `place` is its earliest now."""
        known = self.places.get(key)
        if known is not None and known < place:
            return True
        if known is None and len(self.places) >= self.most:
            self.places.clear()
        self.places[key] = place
        return False


def hot_rows(data: np.ndarray, places: list, gram: np.ndarray, first: np.ndarray, number: np.ndarray, offset: np.ndarray, met: tuple[Met, Met]):
    """(index, first start, number of starts, new) of rows for records of hot grams.

    Runs that a record or string met before repeats are settled; every other string is a row (`new`).
    places: (doc, tie, start in the text) of the first start of each record.
    """
    raw, out = data.tobytes(), []
    for i, (g, a, n, o, (doc, tie, start)) in enumerate(zip(gram.tolist(), first.tolist(), number.tolist(), offset.tolist(), places, strict=True)):
        if met[0].earlier((g, o, raw[a : a + n + LENGTH - 1]), (doc, tie, start)):
            out.append((i, a, n, False))
            continue
        for k in range(n):
            again = met[1].earlier((g, o - k, raw[a + k : a + k + LENGTH]), (doc, tie, start + k))
            if again and k and not out[-1][3]:
                out[-1] = i, out[-1][1], out[-1][2] + 1, False
            else:
                out.append((i, a + k, 1, not again))
    return tuple(np.array(x) for x in zip(*out, strict=True))


def removed_runs(docs: DataFrame) -> DataFrame:
    """(doc, tie, first, number): starts of strings of 100 bytes that also start earlier. docs: doc, tie, text."""
    spark = docs.sparkSession
    small_batches(spark)

    def grams(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [anchors(data, ends)[0] for data, _, _, ends in packs(batch.column(0).to_pylist())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["gram"])

    counts = docs.select("text").mapInArrow(grams, "gram long").groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
    counts = materialize(counts, "grams")
    n_grams, total, n_hot = counts.agg(F.count("*"), F.sum("n"), F.count(F.when(F.col("n") > HOT, 1))).first()
    known = spark.sparkContext.broadcast(_bits(counts, n_grams))
    hot = spark.sparkContext.broadcast(_bits(counts.filter(F.col("n") > HOT), n_hot) if n_hot else None)
    groups = max(1, int((total or 0) * (LENGTH + 80) // GROUP_BYTES))
    remembered = REMEMBERED

    def records(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc", "tie", "gram", "first", "number", "offset", "span", "group"]
        met = Met(remembered), Met(remembered)

        def rows(doc, tie, gram, first, number, offset, span):
            columns = [doc, tie, gram, first.astype(np.int32), number.astype(np.int32), offset.astype(np.int32), span, np.mod(gram, groups)]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=names)

        for batch in batches:
            ids, ties = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for data, row, start, ends in packs(batch.column(2).to_pylist()):
                gram, first, number, offset = anchors(data, ends)
                keep = np.flatnonzero(_has(known.value, gram))
                gram, first, number, offset = gram[keep], first[keep], number[keep], offset[keep]
                piece = np.searchsorted(ends, first, "right")
                # from the place in `data` to that in the text
                shift = (start - np.append(0, ends[:-1]))[piece]
                doc, tie = ids[row[piece]], ties[row[piece]]
                if hot.value is not None and len(common := np.flatnonzero(is_hot := _has(hot.value, gram))):
                    places = list(zip(doc[common].tolist(), tie[common].tolist(), (first + shift)[common].tolist(), strict=True))
                    i, a, n, new = hot_rows(data, places, gram[common], first[common], number[common], offset[common], met)
                    i = common[i]
                    # a string is grouped by its own hash, settled runs are spread out
                    name = np.where(new, Hashes(data).all_of(LENGTH)[a].view(np.int64), doc[i] + a)
                    spans = pieces(data, a, np.where(new, LENGTH, 0))
                    yield rows(doc[i], tie[i], name, a + shift[i], n, np.where(new, 0, SETTLED), spans)
                    rest = np.flatnonzero(~is_hot)
                    doc, tie, gram, first, number, offset, shift = (x[rest] for x in (doc, tie, gram, first, number, offset, shift))
                if len(gram):
                    yield rows(doc, tie, gram, first + shift, number, offset, pieces(data, first, number + LENGTH - 1))

    def compare(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        settled = pc.equal(table.column("offset"), SETTLED)
        done, table = table.filter(settled), table.filter(pc.invert(settled))
        col = lambda c, t=table: t.column(c).to_numpy().astype(np.int64)
        doc, tie = col("doc"), col("tie")
        out = {c: col(c, done) for c in ("doc", "tie", "first", "number")}
        if len(table):
            spans = table.column("span").combine_chunks()
            spans = spans.chunk(0) if isinstance(spans, pa.ChunkedArray) else spans
            record, first, number = group_repeats(col("gram"), doc, tie, col("first"), col("number"), col("offset"), spans)
            found = {"doc": doc[record], "tie": tie[record], "first": first, "number": number}
            out = {c: np.concatenate((out[c], found[c])) for c in out}
        return pa.table(out)

    out = "doc long, tie long, first long, number long"
    rows = docs.select("doc", "tie", "text").mapInArrow(
        records, "doc long, tie long, gram long, first int, number int, offset int, span binary, group long"
    )
    return materialize(rows.groupBy("group").applyInArrow(compare, out), "runs")


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `kept` (the bytes left), `n_bytes`, `n_removed` and `n_spans` (runs of removed bytes)."""
    return carried(docs, {doc_id, text}, ("kept", "n_bytes", "n_removed", "n_spans"), lambda own: _without_repeats(own, doc_id, text))


def _without_repeats(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    keyed = docs.withColumns({"_doc": F.coalesce(F.col(doc_id), F.lit(NO_ID)).cast("long"), "_tie": F.xxhash64(text_of(docs, text))})
    runs = removed_runs(keyed.select(F.col("_doc").alias("doc"), F.col("_tie").alias("tie"), text_of(docs, text).alias("text")))
    lists = runs.groupBy("doc", "tie").agg(F.collect_list("first").alias("_first"), F.collect_list("number").alias("_number"))
    joined = keyed.join(lists, (F.col("_doc") == F.col("doc")) & (F.col("_tie") == F.col("tie")), "left")
    rest = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans")]
    rows = joined.select(*rest, "_first", "_number")
    schema = with_fields(
        docs.select(*rest), ("kept", T.BinaryType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType())
    )
    fields = arrow_schema(schema)
    small_batches(docs.sparkSession)

    def cut(batches: Iterator) -> Iterator:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            found = {k: [] for k in ("kept", "n_bytes", "n_removed", "n_spans")}
            for t, first, number in zip(get(text).to_pylist(), get("_first"), get("_number"), strict=True):
                data = np.frombuffer((t or "").encode(), np.uint8)
                gone = np.zeros(len(data) + 1, np.int32)
                if first.is_valid:
                    a, n = first.values.to_numpy(), number.values.to_numpy()
                    np.add.at(gone, a, 1)
                    np.add.at(gone, a + n - 1 + LENGTH, -1)
                gone = np.cumsum(gone[:-1]) > 0
                found["kept"].append(data[~gone].tobytes())
                found["n_bytes"].append(len(data))
                found["n_removed"].append(int(gone.sum()))
                found["n_spans"].append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            yield arrow_rows(batch, fields, **found)

    return rows.mapInArrow(cut, schema)
