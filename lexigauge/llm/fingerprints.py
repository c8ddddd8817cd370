"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, long ones cut behind a sentence end after LEAST characters, or, if
no end comes before RUN or between LEAST and MOST, at a word end that the text itself picks (behind one of
some letters) within SPAN characters of RUN or LEAST, else at any word end there, else anywhere. So no
paragraph is longer than MOST, and what is cut depends on the next MOST characters only. Each
distinct paragraph has a 64-bit digest. A text below about LEAST characters with an end before RUN is one
paragraph. A sketch has 3 rows of cells; every digest is added to one
cell of each row (count, xor of digests, xor of check hashes). The sketch of one text minus that of
another keeps just the digests in which they differ, and peeling recovers them: a cell with count 1
or -1 whose check fits holds a single digest, which is taken out of its other cells, and so on.

The fingerprint is the sketch of CELLS cells. If its difference can't be peeled, the digests are dealt
by hash to groups of about PER_GROUP and each group gets a sketch of its own; a group that fails
again is retried with twice the cells and another seed, RETRIES times, and at last its digests are
compared as they are. So the likeness, the Jaccard similarity of the two sets of paragraphs, is exact
and the work grows with the length of a text.

A null text is empty and has no paragraphs; two empty texts have likeness 1. The next document is the
one after in ascending doc_id (null ids first; of equal ids by text), after the last the first. Rows
that repeat come back each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, text_of

LEAST = 250
MOST = 400
#: Characters without a sentence end behind which a paragraph is cut, and how far a cut may lie behind that.
RUN = 140
SPAN = 60
CELLS = 48
PER_GROUP = 12
RETRIES = 4
ROUNDS = 40
#: Ranges of doc_id whose bounds the driver knows.
RANGES = 256


def _cut(least: int) -> str:
    """From `least` characters to a word end behind some letters or to a mark of scripts without blanks; else to any word end, else to the limit."""
    n = rf"[^\n]{{{least},{least + SPAN}}}?"
    return rf"(?:{n}(?:[adnouyаиойям](?=\s)|[。！？，、])|{n}(?=\s)|[^\n]{{{least + SPAN}}})"


#: Each alternative looks at MOST + 1 characters at most.
PARAGRAPH = "|".join([
    rf"(?![^\n]{{0,{RUN - 1}}}?[.!?]\s){_cut(RUN)}",
    rf"[^\n]{{{LEAST},{MOST - 1}}}?[.!?](?=\s)",
    rf"(?=[^\n]{{{MOST + 1}}}){_cut(LEAST)}",
    rf"[^\n]{{1,{MOST}}}",
])


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    parts = F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(F.trim(p))))


def _check(k: Column) -> Column:
    return F.xxhash64(F.lit("check"), k)


def _place(k: Column, row: int, cells: int, seed: int) -> Column:
    """The cell of a digest in a row."""
    return (F.pmod(F.xxhash64(F.lit(seed * 3 + row), k), F.lit(cells // 3)) + row * (cells // 3)).cast("int")


def sketch(digests: Column, cells: int = CELLS, seed: int = 0) -> Column:
    """The cells of a set of digests."""
    placed = F.transform(
        digests, lambda k: F.struct(k.alias("k"), _check(k).alias("h"), *[_place(k, r, cells, seed).alias(f"p{r}") for r in range(3)])
    )

    def fill(keys: Column) -> Column:
        def cell(row: int):
            def made(i: Column) -> Column:
                mine = F.filter(keys, lambda x: x[f"p{row}"] == i)
                zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
                return F.aggregate(
                    mine, zero, lambda c, x: F.struct((c["n"] + 1).alias("n"), c["k"].bitwiseXOR(x["k"]).alias("k"), c["h"].bitwiseXOR(x["h"]).alias("h"))
                )

            return made

        w = cells // 3
        return F.concat(*[F.transform(F.sequence(F.lit(r * w), F.lit(r * w + w - 1)), cell(r)) for r in range(3)])

    return let(placed, fill)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h"))
    )


def peel(difference: Column, cells: int = CELLS, seed: int = 0) -> Column:
    """(only_a, only_b): how many digests only one side has; null if they can't all be recovered."""

    def pure(table: Column) -> Column:
        fit = F.filter(table, lambda c: (F.abs(c["n"]) == 1) & (c["h"] == _check(c["k"])))
        # a digest alone in several cells is taken once
        return F.array_distinct(F.transform(fit, lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k"), c["h"].alias("h"), *[_place(c["k"], r, cells, seed).alias(f"p{r}") for r in range(3)])))

    def take(state: Column, found: Column) -> Column:
        def rest(c: Column, i: Column) -> Column:
            mine = F.filter(found, lambda x: (x["p0"] == i) | (x["p1"] == i) | (x["p2"] == i))
            return F.aggregate(mine, c, lambda c, x: F.struct((c["n"] - x["n"]).alias("n"), c["k"].bitwiseXOR(x["k"]).alias("k"), c["h"].bitwiseXOR(x["h"]).alias("h")))

        count = lambda sign: F.size(F.filter(found, lambda x: x["n"] == sign))
        return F.struct(
            F.transform(state["cells"], rest).alias("cells"), (state["a"] + count(1)).alias("a"), (state["b"] + count(-1)).alias("b"), (F.size(found) == 0).alias("done")
        )

    def step(state: Column, _: Column) -> Column:
        return F.when(state["done"], state).otherwise(let(pure(state["cells"]), lambda found: take(state, found)))

    def result(state: Column) -> Column:
        empty = F.forall(state["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["h"] == 0))
        return F.when(empty, F.struct(state["a"].alias("only_a"), state["b"].alias("only_b")))

    start = F.struct(difference.alias("cells"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, result)


def _group_difference(a: Column, b: Column) -> Column:
    """The same for the digests of one group, with larger sketches until one can be peeled."""
    tries = [peel(subtract(sketch(a, CELLS << r, r + 1), sketch(b, CELLS << r, r + 1)), CELLS << r, r + 1) for r in range(RETRIES)]
    return F.coalesce(*tries, F.struct(F.size(F.array_except(a, b)).alias("only_a"), F.size(F.array_except(b, a)).alias("only_b")))


def differing(a_digests: Column, b_digests: Column, a_sketch: Column, b_sketch: Column) -> Column:
    """(only_a, only_b) of two texts: by their fingerprints, else by larger sketches."""

    def grouped(n: Column) -> Column:
        mine = lambda c, g: F.filter(c, lambda k: F.pmod(F.xxhash64(F.lit("group"), k), n) == g)
        found = F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda g: F.get(F.transform(F.array(F.struct(mine(a_digests, g).alias("a"), mine(b_digests, g).alias("b"))), lambda x: _group_difference(x["a"], x["b"])), 0),
        )
        zero = F.struct(F.lit(0).alias("only_a"), F.lit(0).alias("only_b"))
        return F.aggregate(found, zero, lambda s, x: F.struct((s["only_a"] + x["only_a"]).alias("only_a"), (s["only_b"] + x["only_b"]).alias("only_b")))

    n = F.ceil(F.greatest(F.size(a_digests), F.size(b_digests)) / F.lit(PER_GROUP)).cast("int")
    # more digests apart than cells can't be peeled: the counts of the cells tell
    return F.coalesce(peel(subtract(a_sketch, b_sketch)), let(F.greatest(n, F.lit(1)), grouped))


def likeness(n_a: Column, n_b: Column, apart: Column) -> Column:
    """Jaccard similarity from the sizes of two sets and the digests only one has."""
    shared = n_a - apart["only_a"]
    union = n_b + apart["only_a"]
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def written(cells: Column) -> Column:
    """A sketch as text: 34 hex digits a cell."""
    return F.array_join(F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["n"].bitwiseAND(F.lit(255))), 2, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["h"]), 16, "0"))), "")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, next): each text and that of the next document, without ordering all rows in one task.

    Ids are cut into ranges at quantiles. A range's last row finds its next one in a copy of the first
    row of the next range, the last range in that of the first. At most RANGES rows reach the driver.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(docs, text).alias("text"))
    ids = rows.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [k / RANGES for k in range(1, RANGES)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    ranged = F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))), F.lit(0))
    firsts = ids.withColumn("range", ranged).groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("f")).orderBy("range").collect()
    if not firsts:
        return rows.withColumn("next", F.lit(""))
    copies = [(r.f.doc_id, firsts[k - 1].range, int(k == 0)) for k, r in enumerate(firsts)]
    extra = docs.sparkSession.createDataFrame(copies, "first long, to int, after int")
    # all rows of the first id are copied: the first of them by text is then next
    marked = rows.join(F.broadcast(extra), F.col("doc_id").eqNullSafe(F.col("first")), "left")
    own = F.struct(ranged.alias("range"), F.lit(0).alias("copy"))
    copy = F.struct(F.col("to").alias("range"), F.lit(1).alias("copy"))
    both = marked.select("doc_id", "text", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("at"))
    order = Window.partitionBy("at.range").orderBy("at.copy", F.col("doc_id").asc_nulls_first(), "text")
    return both.withColumn("next", F.lead("text").over(order)).filter("at.copy = 0").select("doc_id", "text", "next")


def edited_text(text: Column, following: Column) -> Column:
    """The last quarter of the characters replaced by as many first ones of the next text."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))


def compare_versions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, cells, edited_cells, near_edited, near_next) of every document."""
    rows = with_next(docs, doc_id, text)
    # each step's columns pass through a one-row generator, so that they are computed once
    once = lambda df, **cols: df.select("*", F.explode(F.array(F.struct(*[v.alias(k) for k, v in cols.items()]))).alias("_x")).select(*df.columns, "_x.*")
    rows = once(rows, edited=edited_text(F.col("text"), F.col("next")))
    rows = once(rows, a=paragraphs(F.col("text")), e=paragraphs(F.col("edited")), x=paragraphs(F.col("next"))).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "a", "e", "x"
    )
    rows = once(rows, cells=sketch(F.col("a")), edited_cells=sketch(F.col("e")), next_cells=sketch(F.col("x")))
    rows = once(
        rows,
        to_edited=differing(F.col("a"), F.col("e"), F.col("cells"), F.col("edited_cells")),
        to_next=differing(F.col("a"), F.col("x"), F.col("cells"), F.col("next_cells")),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "cells", "edited_cells",
        likeness(F.size("a"), F.size("e"), F.col("to_edited")).alias("near_edited"),
        likeness(F.size("a"), F.size("x"), F.col("to_next")).alias("near_next"),
    )
