"""Near-duplicate lines by an exact set-similarity join, the later ones removed.

A line is the set of its words (split at white space, lower-cased). Two lines match if the Jaccard
similarity of their sets is 0.8 or more. A line is removed if a line before it, in an earlier document
(by doc_id) or earlier in its own, matches it; lines are judged on the input, removed ones count as
well. Blank lines have no words and stay.

Lines with equal sets are one set that first stands at one place. Each set is first compared with the
one set that stands first among those it shares a key with; most near copies match it and are settled,
so a group of n takes n pairs. What stays open is found by a join with all sets:
the words of a set are put in order of rarity, and only the prefix of the rarest is joined: a set of s
words that shares 0.8 with another shares one of its s - ceil(0.8 s) + 1 rarest. Lists are kept by word
and class of size, a smaller set also one class up. Pairs that meet there must pass the length filter
and the positional filter (what may still follow in both after their first common word), and the parities of 128 bits into which each word puts one must not differ in more
bits than the sets may in words; then the whole sets are compared.
Rarity is the corpus count of a word's hash bucket, of which there is a fixed number; any common
order keeps the join exact.

A null text has no lines and stays null. Rows that share a doc_id come in the order of a hash of their
texts, those that share the text as well are one document; null ids come first. Other columns are kept; `n_lines` and `n_removed` are replaced if they exist.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_within, materialize
from .common import carried, constant_longs

SIMILARITY = 0.8
#: Counters of words, a power of two; their number does not grow with the data.
BUCKETS = 1 << 16
BROADCAST_ROWS = 200_000
#: Keys or ids (longs) that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Words from which on a set is looked up by its parities, where few edits leave most bits, not by its rarest words.
LARGE = 32
#: Where a line stands; places sort as lines do.
PLACE = ("doc_id", "tie", "line_no")


def _lines(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", F.xxhash64(text).alias("tie"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return split.filter(F.col("line").rlike("\\S"))


def _pieces(line: Column) -> Column:
    """The lower-case words of a line, with empty ones between blanks; a cut at one plain blank is much faster than at a pattern."""
    plain = F.when(line.rlike("[\\t\\x0B\\f\\r]"), F.translate(line, "\t\x0b\f\r", "    ")).otherwise(line)
    return F.split(F.lower(plain), " ")


def _hashes(line: Column) -> Column:
    """The distinct words of a line as hashes; the empty one is dropped as a number, which needs no comparison of texts."""
    return F.array_remove(F.array_distinct(F.transform(_pieces(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _levels(docs: DataFrame) -> Column:
    """For each bucket one of 16 levels by count, doubling from a sixteenth of the mean on: 4 bits, 16 buckets to a long.

    Every plan that looks words up holds this table, and the driver holds the plans.
    """
    words = _lines(docs).select(F.explode(F.array_remove(_pieces(F.col("line")), "")).alias("w"))
    hashed = words.select(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1).cast("long")).alias("bucket"))
    counts = materialize(hashed.groupBy("bucket").agg(F.count("*").alias("n")), "counts")
    mean = (counts.agg(F.sum("n")).first()[0] or 1) / BUCKETS
    level = F.least(F.greatest(F.floor(F.log2(F.col("n") / F.lit(mean))) + 4, F.lit(0)), F.lit(15)).cast("long")
    # the first of a word's 16 in its top bits
    place = (60 - F.col("bucket") % 16 * 4).cast("int")
    # as the top bits of a long they sort as numbers from -8 to 7
    bits = F.call_function("shiftleft", level.bitwiseXOR(F.lit(8).cast("long")), place)
    packed = counts.groupBy(F.shiftright("bucket", 4).cast("int")).agg(F.bit_or(bits))
    return constant_longs(packed.collect(), BUCKETS // 16)  # that many rows at most


def _level(table: Column, bucket: Column) -> Column:
    """A long with the level of a bucket as its top bits, the others given by the bucket: a shift of a long counts modulo 64."""
    word = F.get(table, F.shiftright(bucket, 4))
    # an array that can't hold nulls is sorted as plain numbers
    return F.coalesce(F.call_function("shiftleft", word, bucket * 4), F.lit(0).cast("long"))


def _with_sets(lines: DataFrame, levels: Column) -> DataFrame:
    """Place, `size`, two hashes of the whole set, which name it by 128 bits, and the words as numbers: `low` and `high`.

    A word's number sorts by rarity: 4 bits of level, then 28 of its hash, some flipped as the bucket says. 28 bits do
    for the lists: words that share them only add candidates. `low` has the words with negative hashes.
    """
    # what stands in a generator or under a lambda function is interpreted, so each step is a projection of its own;
    # Spark leaves those apart whose columns are used twice
    zero = F.lit(0).cast("long")
    hashed = lines.select(*PLACE, F.sort_array(F.concat(F.array(zero), _hashes(F.col("line")))).alias("hashes"))
    zero_at = F.array_position("hashes", zero).cast("int")
    halves = {"low": F.slice("hashes", F.lit(1), zero_at - 1), "high": F.slice("hashes", zero_at + 1, F.size("hashes"))}
    cut = hashed.select(
        *PLACE, F.xxhash64("hashes").alias("k1"), F.xxhash64(F.lit(1), "hashes").alias("k2"), *[half.alias(name) for name, half in halves.items()]
    )
    bucket = lambda h: h.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")
    number = lambda h: F.shiftright(_level(levels, bucket(h)).bitwiseXOR(F.shiftrightunsigned(h, 4)), 32).cast("int")
    return cut.select(*PLACE, "k1", "k2", (F.size("low") + F.size("high")).alias("size"), *[F.transform(name, number).alias(name) for name in halves])


def _need(a: Column, b: Column, similarity: float) -> Column:
    """Words that sets of these sizes must share."""
    return F.ceil((a + b) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9))


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, tie, line_no) of every line that matches one before it; tie: xxhash64 of the text."""
    docs = docs.select("doc_id", "text")
    levels = _levels(docs)
    size = F.col("size")
    n = size - F.ceil(size * F.lit(similarity) - F.lit(1e-9)).cast("int") + 1
    prefix = F.slice(F.sort_array(F.concat("low", "high")), F.lit(1), n)
    # a shift of a long counts modulo 64
    flip = lambda acc, w: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), w))
    parities = [F.aggregate(half, F.lit(0).cast("long"), flip).alias(name) for half, name in (("low", "even"), ("high", "odd"))]
    named = _with_sets(_lines(docs), levels).select(*PLACE, "size", *parities, "k1", "k2", prefix.alias("prefix"))
    lines = materialize(named, "lines")
    place = F.struct(*PLACE)
    sets = lines.groupBy("k1", "k2", "size").agg(
        F.min(place).alias("place"), F.count("*").alias("copies"), F.first("even").alias("even"), F.first("odd").alias("odd"), F.first("prefix").alias("prefix")
    )
    sets = materialize(sets.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "size", "copies", "place.*", "even", "odd", "prefix"), "sets")
    # a smaller set matches none but its equals: one word more is too many
    able = sets.filter(F.col("size") >= (F.col("size") + 1) * F.lit(similarity) - F.lit(1e-9))
    first = materialize(_verified(docs, _with_first(able, similarity), similarity), "matched_first")
    second = _verified(docs, _with_any(able, first, similarity), similarity)
    matched = broadcast_within(materialize(first.union(second), "matched"), BROADCAST_KEYS).withColumn("found", F.lit(True))
    later = sets.join(matched, "id", "left").filter((F.col("copies") > 1) | F.col("found")).select("k1", "k2", "size", place.alias("place"), "found")
    removed = lines.join(later, ["k1", "k2", "size"]).filter(F.col("found").isNotNull() | (place != F.col("place")))
    return removed.select(*PLACE)


def _may_match(x, y, similarity: float) -> tuple[Column, Column]:
    """The length and the parity filter for two sets, and by how many bits their parities differ."""
    apart = F.bit_count(x("even").bitwiseXOR(y("even"))) + F.bit_count(x("odd").bitwiseXOR(y("odd")))
    alike = F.least(x("size"), y("size")) >= F.greatest(x("size"), y("size")) * F.lit(similarity) - F.lit(1e-9)
    # each word only one has flips a bit of the parities, so they differ in no more bits than that
    return alike & (apart <= x("size") + y("size") - 2 * _need(x("size"), y("size"), similarity)), apart


def _class_width(similarity: float) -> float:
    """Sets that can match are of the same class of log(size) or of neighbouring ones."""
    return math.log(1 / similarity) + 1e-6


def _with_first(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, id): for a set the likeliest of those that stand first of the sets that share a key with it, if it may match.

    A set that needs only one match before it needs no other pair once this one is verified, so a group of n near
    copies takes n pairs here and leaves few for `_with_any`, which finds the match of every other set. Keys are
    words of the prefix with the size; of large sets fifths of the parities, of which few edits leave one as it was.
    """
    size_class = F.floor(F.log("size") / F.lit(_class_width(similarity)))
    # 26 bits four times, and the 12 left over in both halves
    bits = lambda half, at: F.call_function("shiftrightunsigned", F.col(half), F.lit(at)).bitwiseAND(F.lit((1 << 26) - 1).cast("long"))
    fifths = [[bits("even", 0)], [bits("even", 26)], [bits("odd", 0)], [bits("odd", 26)], [bits("even", 52), bits("odd", 52)]]
    # rare words of its own come first, so the last two of the prefix
    words = F.transform(F.slice(F.reverse("prefix"), F.lit(1), F.lit(2)), lambda w: F.xxhash64(w, "size"))
    parts = F.array(*[F.xxhash64(*part, F.lit(i), size_class) for i, part in enumerate(fifths)])
    keyed = sets.select("id", *PLACE, "size", "even", "odd", F.explode(F.when(F.col("size") < LARGE, words).otherwise(parts)).alias("key"))
    shared = materialize(keyed.select("key").groupBy("key").count().filter("count > 1").select("key"), "shared_keys")
    keyed = materialize(keyed.join(broadcast_within(shared, BROADCAST_KEYS), "key"), "keyed")
    place = F.struct(*PLACE)
    firsts = keyed.groupBy("key").agg(F.min(F.struct(*PLACE, "size", "even", "odd")).alias("first"))
    x, y = (lambda c: F.col(f"first.{c}")), F.col
    may, apart = _may_match(x, y, similarity)
    a = F.struct(*[x(c).alias(c) for c in PLACE])
    pairs = keyed.join(firsts, "key").filter(may & (a < place)).select("id", place.alias("b"), a.alias("a"), apart.alias("apart"))
    return pairs.groupBy("id", "b").agg(F.min_by("a", "apart").alias("a"))


def _with_any(sets: DataFrame, matched: DataFrame, similarity: float) -> DataFrame:
    """(a, b, id): every pair of sets that share a word of their prefixes and may match, b the later one and not in `matched`."""
    done = broadcast_within(matched, BROADCAST_KEYS).withColumn("done", F.lit(True))
    listed = _listed(sets.join(done, "id", "left").withColumn("open", F.col("done").isNull()), similarity)
    pairs = materialize(_meeting(listed, similarity).distinct(), "candidates")
    placed = sets.select("id", F.struct(*PLACE).alias("place"))
    x, y = (placed.select(F.col("id").alias(n), F.col("place").alias(f"place_{n}")) for n in "xy")
    both = pairs.join(x, "x").join(y, "y")
    first = F.col("place_x") < F.col("place_y")
    one_of = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return both.filter(one_of("open_y", "open_x")).select(one_of("place_x", "place_y").alias("a"), one_of("place_y", "place_x").alias("b"), one_of("y", "x").alias("id"))


def _listed(sets: DataFrame, similarity: float) -> DataFrame:
    """One row for each word of the prefix of each set, listed by word and class of size (`word`).

    A set is also listed one class up, with the words that it can first share with a set of that class.
    This table is the largest of all, so small numbers share a long (`packed`): size, place in the prefix, up, open.
    """
    width = _class_width(similarity)
    size_class = F.floor(F.log("size") / F.lit(width))
    least = F.ceil(F.exp((size_class + 1) * F.lit(width)) - F.lit(1e-6))
    words_up = F.when(F.col("size") >= least * F.lit(similarity) - F.lit(1e-9), F.greatest(F.col("size") - _need(F.col("size"), least, similarity) + 1, F.lit(0))).otherwise(0)
    own = sets.select("id", "doc_id", "size", "even", "odd", "open", size_class.alias("class"), "prefix", words_up.cast("int").alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("up"))
    words = F.when(F.col("up") == 0, F.col("prefix")).otherwise(F.slice("prefix", F.lit(1), F.col("n")))
    listed = own.select("id", "doc_id", "size", "even", "odd", "open", "up", (F.col("class") + F.col("up")).alias("class"), F.posexplode(words).alias("at", "word"))
    packed = F.col("size") * F.lit(1 << 32) + F.col("at") * 4 + F.col("up") * 2 + F.col("open").cast("int")
    return listed.select("id", "doc_id", "even", "odd", packed.alias("packed"), (F.col("class") * F.lit(1 << 32) + F.col("word")).alias("word"))


def _unpacked(side: str):
    """The columns of a listed set by name."""
    packed = F.col(f"{side}.packed")
    bits = lambda n: packed.bitwiseAND(F.lit(n).cast("long"))
    made = {"size": F.shiftright(packed, 32), "at": F.shiftright(bits((1 << 32) - 1), 2), "up": bits(2), "open": bits(1) == 1}
    return lambda c: made[c] if c in made else F.col(f"{side}.{c}")


def _meeting(listed: DataFrame, similarity: float) -> DataFrame:
    """(x, y, open_x, open_y): sets that meet in a list and pass the length, the positional and the parity filter, the later one open."""
    # aliases of the tables, not of their columns: so both sides are the same exchange
    x, y = _unpacked("x"), _unpacked("y")
    may, _ = _may_match(x, y, similarity)
    # within a document, or where ids are null, the order is looked up later
    later_open = F.when(x("doc_id") < y("doc_id"), y("open")).when(y("doc_id") < x("doc_id"), x("open")).otherwise(x("open") | y("open"))
    meets = (
        (x("word") == y("word"))
        # the smaller on the left, and it alone listed one class up
        & ((x("size") < y("size")) | ((x("size") == y("size")) & (x("id") < y("id"))))
        & (x("up") + y("up") < 4)
        & may
        # a pair passes at its first common word, before which neither has another
        & (F.least(x("size") - x("at"), y("size") - y("at")) >= _need(x("size"), y("size"), similarity))
        & later_open
    )
    return listed.alias("x").join(listed.alias("y"), meets).select(x("id").alias("x"), y("id").alias("y"), x("open").alias("open_x"), y("open").alias("open_y"))


def _verified(docs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """(id) of the sets `b` that match a set `a` before them."""
    pairs = materialize(pairs, "pairs")
    places = pairs.select(F.col("a").alias("place")).union(pairs.select(F.col("b").alias("place"))).distinct()
    wanted = materialize(places.select("place.*"), "places")
    only = broadcast_within(wanted, BROADCAST_ROWS)
    same = lambda l, r: l["doc_id"].eqNullSafe(r["doc_id"]) & (l["tie"] == r["tie"]) & (l["line_no"] == r["line_no"])
    rows = _lines(docs)
    rows = rows.join(only, same(rows, only), "left_semi")
    # the hashes need no order here; one generated row: the words are computed once
    words = F.explode(F.array(_hashes(F.col("line"))))
    words = materialize(rows.select(F.struct(*PLACE).alias("place"), words.alias("words")), "words")
    a, b = words.select(F.col("place").alias("a"), F.col("words").alias("x")), words.select(F.col("place").alias("b"), F.col("words").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    matches = pairs.join(a, "a").join(b, "b").filter(both >= _need(F.size("x"), F.size("y"), similarity))
    return matches.select("id").distinct()


def drop_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with the lines left in `text`, and `n_lines` and `n_removed`."""
    return carried(docs, {"doc_id", "text"}, ("n_lines", "n_removed"), lambda own: _without_lines(own, similarity))


def _without_lines(docs: DataFrame, similarity: float) -> DataFrame:
    gone = repeated_lines(docs, similarity).groupBy("doc_id", "tie").agg(F.collect_set("line_no").alias("_gone"))
    gone = materialize(gone.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "_gone"), "gone")
    # few lines are sent to where the texts are; else the texts are shuffled
    if (gone.agg(F.sum(F.size("_gone"))).first()[0] or 0) <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    rest = docs.drop("n_lines", "n_removed")
    tie = F.xxhash64(F.coalesce(rest["text"], F.lit("")))
    rows = rest.join(gone, rest["doc_id"].eqNullSafe(F.col("_id")) & (tie == F.col("_tie")), "left").drop("_id", "_tie")
    rows = rows.withColumn("_split", F.split("text", "\n"))
    none = F.array().cast("array<int>")
    # an array of numbers is searched once for each line, so both are walked through in order
    flags = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), F.coalesce("_gone", none))
    left = F.transform(flags, lambda i: F.get("_split", i))
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return rows.select(
        *[kept.alias("text") if c == "text" else F.col(c) for c in rest.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_split")).cast("long").alias("n_lines"),
        F.size(F.coalesce("_gone", none)).cast("long").alias("n_removed"),
    )
