"""Cutting long texts at periods or sentences and packing the pieces into chunks.

The functions are steps: an operator keeps each result in a column before the next step
reads it, so that no step is evaluated more than once per text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items of a block of a fold, and characters of a block of text.
_FOLD_BLOCK, _TEXT_BLOCK = 512, 1024


def _none() -> Column:
    return F.array().cast("array<int>")


def _let(value: Column, then) -> Column:
    """`then(value)`, the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _fold(items: Column, zero: Column, advance, emitted, last) -> Column:
    """The numbers that `emitted(state, item)` gives along a fold of `advance(state, item)`, then those of `last(state)`.

    Spark copies a fold's state at each step, so a list in it makes the work grow with its square.
    Here a first fold finds the state each block of items begins with, and the lists are made block by block.
    """
    size = F.lit(_FOLD_BLOCK)

    def listed(block: Column, begin: Column, end) -> Column:
        return F.aggregate(
            block,
            F.struct(begin.alias("state"), _none().alias("out")),
            lambda a, item: F.struct(advance(a["state"], item).alias("state"), F.concat(a["out"], emitted(a["state"], item)).alias("out")),
            end,
        )

    def by_blocks(all_items: Column) -> Column:
        n_blocks = F.ceil(F.size(all_items) / size).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), n_blocks), lambda i: F.slice(all_items, (i - 1) * size + 1, size))

        def begun(blocks: Column) -> Column:
            def step(a, block):
                behind = F.aggregate(block, a["state"], advance)
                return F.struct(behind.alias("state"), F.concat(a["begins"], F.array(a["state"])).alias("begins"))

            return F.aggregate(blocks, F.struct(zero.alias("state"), F.slice(F.array(zero), F.lit(1), F.lit(0)).alias("begins")), step)

        def joined(blocks: Column) -> Column:
            def of(found: Column) -> Column:
                pairs = F.arrays_zip(blocks.alias("block"), found["begins"].alias("begin"))
                return F.concat(F.flatten(F.transform(pairs, lambda x: listed(x["block"], x["begin"], lambda a: a["out"]))), last(found["state"]))

            return _let(begun(blocks), of)

        return _let(blocks, joined)

    def folded(all_items: Column) -> Column:
        one = listed(all_items, zero, lambda a: F.concat(a["out"], last(a["state"])))
        return F.when(F.size(all_items) <= size, one).otherwise(by_blocks(all_items))

    return _let(items, folded)


def period_cuts(text: Column, max_length: int) -> Column:
    """End positions of pieces of at most `max_length` characters, cut after periods.

    A piece ends after the last period in its window; a period in the first place of the
    window does not count, and a window without a usable period is cut at full length.
    One fold over the period-terminated runs: `start` of the open piece, `cut` = the last usable
    cut in it (`start` if none), `pos` = text consumed.
    """
    if max_length < 1:
        raise ValueError("max_length must be at least 1")
    limit = F.lit(max_length)
    runs = F.transform(
        F.regexp_extract_all(text, F.lit(r"[^.]*\.|[^.]+"), F.lit(0)),
        lambda r: F.struct(F.length(r).alias("n"), F.endswith(r, F.lit(".")).alias("stop")),
    )
    none, zero = _none(), F.lit(0)

    def state(start, cut, pos):
        return F.struct(start.alias("start"), cut.alias("cut"), pos.alias("pos"))

    def fits(s, run):
        return run["stop"] & (s["pos"] + run["n"] - s["start"] <= limit)

    def windows(s, run):
        """Where a run that does not fit begins once the open piece is closed, and how many full windows it has."""
        begin = F.greatest(s["cut"], s["start"])
        return begin, F.floor((s["pos"] + run["n"] - begin - 1) / limit).cast("int")

    def step(s, run):
        end = s["pos"] + run["n"]
        begin, n_full = windows(s, run)
        final = begin + n_full * limit

        def usable(start):
            return F.when(end - start >= 2, end).otherwise(start)

        return (
            F.when(fits(s, run), state(s["start"], usable(s["start"]), end))
            .when(run["stop"], state(final, usable(final), end))
            .otherwise(state(end, end, end))
        )

    def emitted(s, run):
        # A run that does not fit closes the open piece and is cut into full windows.
        end = s["pos"] + run["n"]
        begin, n_full = windows(s, run)
        closed = F.when(s["cut"] > s["start"], F.array(s["cut"])).otherwise(none)
        full = F.when(
            n_full > 0,
            F.transform(F.sequence(F.lit(1), F.greatest(n_full, F.lit(1))), lambda i: begin + i * limit),
        ).otherwise(none)
        rest = F.when(run["stop"], none).otherwise(F.array(end))
        return F.when(fits(s, run), none).otherwise(F.concat(closed, full, rest))

    def last(s):
        return F.when(s["pos"] > s["start"], F.array(s["pos"])).otherwise(none)

    return _fold(runs, state(zero, zero, zero), step, emitted, last)


def pieces_at(text: Column, cuts: Column) -> Column:
    """The pieces of a text that end at the given positions; together they are the text.

    A piece is taken out of the blocks of the text it touches, not counted from the text's start.
    """
    starts = F.concat(F.array(F.lit(0)), F.slice(cuts, F.lit(1), F.greatest(F.size(cuts) - 1, F.lit(0))))
    spans = F.filter(F.arrays_zip(starts.alias("a"), cuts.alias("b")), lambda s: s["b"].isNotNull())
    size = F.lit(_TEXT_BLOCK)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_TEXT_BLOCK}}}"), F.lit(0))

    def taken(blocks: Column) -> Column:
        def piece(s):
            first, last = F.floor(s["a"] / size).cast("int"), F.floor((s["b"] - 1) / size).cast("int")
            near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
            return F.substring(near, s["a"] - first * size + 1, s["b"] - s["a"])

        return F.transform(spans, piece)

    return F.when(F.length(text) <= size, F.transform(spans, lambda s: F.substring(text, s["a"] + 1, s["b"] - s["a"]))).otherwise(_let(blocks, taken))


def sentence_pieces(text: Column) -> Column:
    """The text cut after its sentence terminators, nothing dropped."""
    return F.regexp_extract_all(text, F.lit(r"[^.!?]*[.!?]+|[^.!?]+"), F.lit(0))


def chunk_firsts(pieces: Column, max_length: int) -> Column:
    """1-based index of the first piece of every chunk.

    Pieces are packed greedily, in order, until their lengths would sum above `max_length`;
    a piece longer than the limit keeps a chunk of its own.
    """
    limit = F.lit(max_length)

    def full(s, n):
        return (s["used"] > 0) & (s["used"] + n > limit)

    def step(s, n):
        used = F.when(full(s, n), n).otherwise(s["used"] + n)
        return F.struct(used.alias("used"), (s["i"] + 1).alias("i"))

    def emitted(s, n):
        return F.when(full(s, n) | (s["i"] == 1), F.array(s["i"])).otherwise(_none())

    begin = F.struct(F.lit(0).alias("used"), F.lit(1).alias("i"))
    return _fold(F.transform(pieces, F.length), begin, step, emitted, lambda s: _none())


def chunks_from(pieces: Column, firsts: Column) -> Column:
    """The chunks: pieces of a chunk are joined with one space (which is not counted)."""
    spans = F.arrays_zip(
        firsts.alias("a"), F.slice(firsts, F.lit(2), F.greatest(F.size(firsts), F.lit(1))).alias("b")
    )
    return F.transform(
        spans,
        lambda s: F.array_join(
            F.slice(pieces, s["a"], F.coalesce(s["b"], F.size(pieces) + 1) - s["a"]), " "
        ),
    )
