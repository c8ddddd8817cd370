"""Byte-level BPE by backtracking: exact merges in time linear in the text.

The vocabulary's tokens stand in an Aho-Corasick automaton. From each position the longest token is
tried first, then its shorter prefixes, and a token is accepted only if it and the token before it
are compatible: if merging the bytes of both would give just these two tokens. The answers are kept
in a table of pairs. A position from which nothing fits is marked and never tried again.

A null text counts as empty and has no tokens. Rows are encoded each on their own, so repeated rows,
ties and extra columns change nothing; columns called `ids` or `decoded` are replaced.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, arrow_schema, small_batches, with_fields

#: How the vocabulary's format splits text before merging, for ASCII and Latin letters.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
LATIN_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+", re.ASCII)
_LATIN = re.compile(rf"[\x00-\x7f{LETTERS}]*")

#: A piece never crosses a single space between two other characters, so texts can be cut there.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_WIDE_SPACE = re.compile(r"\s | \s")
#: Pieces remembered by a worker; beyond that it starts anew.
CACHE_ENTRIES = 300_000
#: Tokens decoded at a time.
BLOCK = 1 << 16


def byte_characters() -> list[str]:
    """The character by which the vocabulary file writes each byte: itself if it is printable, else one above 255."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file in the format of the tokenizers library."""

    def __init__(self, source: str):
        data = json.loads(source)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        model = data["model"]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.tokens = {i: bytes(byte_of[c] for c in word) for word, i in model["vocab"].items() if word not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged = {(model["vocab"][a], model["vocab"][b]): model["vocab"][a + b] for a, b in pairs}
        self.rank = {pair: n for n, pair in enumerate(self.merged)}
        self.halves = {whole: pair for pair, whole in self.merged.items()}

    def offsets(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' bytes in one array, and where each id begins: id i is bytes[at[i]:at[i + 1]]."""
        size = max([*self.tokens, *self.special.values()]) + 1
        special = {i: s.encode() for s, i in self.special.items()}
        parts = [special.get(i) or self.tokens.get(i, b"") for i in range(size)]
        at = np.zeros(size + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=at[1:])
        return np.frombuffer(b"".join(parts), np.uint8), at


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        from tokenizers import pre_tokenizers

        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for i, token in vocabulary.tokens.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.id_of = {t: i for i, t in vocabulary.tokens.items()}
        self.length = {i: len(t) for i, t in vocabulary.tokens.items()}
        #: The longest token that is a shorter prefix of a token, if any.
        self.shorter = {i: self._shorter(t) for t, i in self.id_of.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        # other text is cut by the library's own character tables, which change with Unicode
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def _shorter(self, token: bytes) -> int | None:
        return next((self.id_of[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.id_of), None)

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens, merged in order of rank, end as these two tokens.

        They don't if some merge joins a suffix of `left` with a prefix of `right` before the
        merges that make the rest of them: the last merges of both are undone, latest first, and
        each pair that then meets at the border must not have come earlier.
        """
        rank, halves = self.v.rank, self.v.halves
        a, b, undone = left, right, len(rank)
        result = True
        while True:
            meeting = rank.get((a, b))
            if meeting is not None and meeting < undone:
                result = False
                break
            # when a and b were made; single bytes were there from the start
            made_a = rank[halves[a]] if a in halves else -1
            made_b = rank[halves[b]] if b in halves else -1
            if made_a < 0 and made_b < 0:
                break
            # of equal pairs the left one is merged first, so the right half's maker is undone at its rank plus one
            if made_a > made_b:
                undone, a = made_a, halves[a][1]
            else:
                undone, b = made_b + 1, halves[b][0]
        if len(self.compatible) > 4 * CACHE_ENTRIES:
            self.compatible.clear()
        self.compatible[left, right] = result
        return result

    def piece(self, text: str) -> list[int]:
        """The tokens of one piece, its bytes written as Latin-1 characters."""
        longest, length, compatible = self.automaton.iter_long, self.length, self.compatible
        # the path on which the longest token is accepted each time, as far as it goes
        out: list[int] = []
        before = None
        for _, token in longest(text):
            ok = before is None or compatible.get((before, token))
            if ok is None:
                ok = self.fits(before, token)
            if not ok:
                break
            out.append(token)
            before = token
        else:
            return out
        end, at = len(text), sum([length[t] for t in out])
        closed: set[int] = set()  # positions from which the rest can't be tokenised
        while True:
            stop = at + length[token]
            if stop not in closed:
                ok = before is None or compatible.get((before, token))
                if ok is None:
                    ok = self.fits(before, token)
                if ok:
                    out.append(token)
                    if stop == end:
                        return out
                    at, before = stop, token
                    token = next(longest(text, at))[1]
                    continue
            token = self.shorter[token]
            if token is None:  # nothing fits here: take back the token before
                closed.add(at)
                token = out.pop()
                at -= length[token]
                before = out[-1] if out else None

    def segment(self, segment: str) -> bytes:
        """The ids of a segment as 4-byte integers."""
        if segment.isascii():
            pieces = LATIN_PIECES.findall(segment)
        elif _LATIN.fullmatch(segment):
            pieces = [p.encode().decode("latin-1") for p in LATIN_PIECES.findall(segment)]
        else:
            pieces = [segment[a:b].encode().decode("latin-1") for _, (a, b) in self.splitter.pre_tokenize_str(segment)]
        if len(pieces) == 1:
            return array("i", self.piece(pieces[0])).tobytes()
        return b"".join([self.cached(p) for p in pieces])

    def cached(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = array("i", self.piece(piece)).tobytes()
            if len(piece) < 64:
                if len(self.pieces) >= CACHE_ENTRIES:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        parts: list[bytes] = []
        cache = self.cache
        for k, chunk in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                parts.append(np.array([self.v.special[chunk]], np.int32).tobytes())
                continue
            if _WIDE_SPACE.search(chunk):
                segments = _CUT.split(chunk)
            else:
                first, *rest = chunk.split(" ")
                segments = [first, *(" " + x for x in rest)]
            for s in segments:
                got = cache.get(s)
                if got is None:
                    got = self.segment(s)
                    if len(s) < 64:
                        if len(cache) >= CACHE_ENTRIES:
                            cache.clear()
                        cache[s] = got
                parts.append(got)
        return np.frombuffer(b"".join(parts), np.int32)


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.bytes, self.at = vocabulary.offsets()

    def decode(self, ids: np.ndarray) -> str:
        # in blocks, as positions take many times the memory of the text
        blocks = [self.block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
        return b"".join(blocks).decode("utf-8", "replace")

    def block(self, ids: np.ndarray) -> bytes:
        start = self.at[ids]
        size = self.at[ids + 1] - start
        last = np.cumsum(size)
        # byte k of the text is byte k - (last - size) of its token
        where = np.arange(last[-1]) + np.repeat(start - (last - size), size)
        return self.bytes[where].tobytes()


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the token ids of each whole text in an array column.

    The file is read by the driver and sent to the executors once; its size does not grow with the data.
    """
    small_batches(docs.sparkSession)
    source = docs.sparkSession.sparkContext.broadcast(open(vocabulary_path, encoding="utf-8").read())
    schema = with_fields(docs, (ids, T.ArrayType(T.IntegerType())))
    fields = arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(Vocabulary(source.value))
            found = [encoder.encode(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            at = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=at[1:])
            values = np.concatenate(found) if found else np.empty(0, np.int32)
            column = pa.ListArray.from_arrays(pa.array(at), pa.array(values, pa.int32()))
            yield arrow_rows(batch, fields, **{ids: column})

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`df` with the text that each array of ids stands for; a null array gives an empty text."""
    small_batches(df.sparkSession)
    source = df.sparkSession.sparkContext.broadcast(open(vocabulary_path, encoding="utf-8").read())
    schema = with_fields(df, (decoded, T.StringType()))
    fields = arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        decoder = None
        for batch in batches:
            decoder = decoder or Decoder(Vocabulary(source.value))
            column = batch.column(batch.schema.get_field_index(ids))
            flat = column.flatten().to_numpy(zero_copy_only=False)
            sizes = [0 if n is None else n for n in column.value_lengths().to_pylist()]
            ends = np.cumsum(sizes) if sizes else []
            texts = [decoder.decode(flat[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
            yield arrow_rows(batch, fields, **{decoded: texts})

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`docs` without its text, with the token ids of each whole text and the text that they decode to.

    One worker does both, so a core holds one vocabulary and no text goes to a second one.
    """
    small_batches(docs.sparkSession)
    source = docs.sparkSession.sparkContext.broadcast(open(vocabulary_path, encoding="utf-8").read())
    rest = docs.drop(text)
    schema = with_fields(rest, (ids, T.ArrayType(T.IntegerType())), (decoded, T.StringType()))
    fields = arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = decoder = None
        for batch in batches:
            if encoder is None:
                vocabulary = Vocabulary(source.value)
                encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
            found, texts = [], []
            for value in batch.column(batch.schema.get_field_index(text)):
                found.append(encoder.encode(value.as_py() or ""))
                texts.append(decoder.decode(found[-1]))
            at = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=at[1:])
            values = np.concatenate(found) if found else np.empty(0, np.int32)
            yield arrow_rows(batch, fields, **{ids: pa.ListArray.from_arrays(pa.array(at), pa.array(values, pa.int32())), decoded: texts})

    return docs.mapInArrow(run, schema)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> list:
    """Columns: number of tokens, and SHA-256 of the ids and of the decoded text."""
    written = F.array_join(F.col(ids).cast("array<string>"), ",")
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(written, 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]
