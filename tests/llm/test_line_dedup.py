import math
import random

from pyspark.sql import functions as F

from lexigauge.llm import line_dedup


def plain(rows):
    """Sets of lines compared with all before them."""
    seen, out = [], []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out.append((doc_id, None, 0, 0))
            continue
        kept, n = [], 0
        for line in text.split("\n"):
            words = set(line.lower().split())
            if words and any(5 * len(words & s) >= 4 * len(words | s) for s in seen):
                n += 1
            else:
                kept.append(line)
            if words:
                seen.append(words)
        out.append((doc_id, "\n".join(kept), len(text.split("\n")), n))
    return out


def corpus():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 3))) for _ in range(150)]
    line = lambda: " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 5, 9, 14, 30])))
    base = [line() for _ in range(80)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rnd.randint(1, 6)):
            x = rnd.choice(base).split() if rnd.random() < 0.6 else line().split()
            for _ in range(rnd.randint(0, 3)):
                if x:
                    x[rnd.randrange(len(x))] = rnd.choice(words)
            lines.append(rnd.choice([" ", "  "]).join(x).capitalize())
        rows.append((i * 3 % 151, "\n".join(lines)))
    return rows + [(500, None), (501, ""), (502, "\n\n"), (503, base[0]), (504, base[0]), (None, "only here, as first of all")]


def test_lines(spark):
    rows = corpus()
    docs = spark.createDataFrame([(a, b, a) for a, b in rows], "doc_id long, text string, n_lines long").repartition(4)
    for limit in (200_000, 0):
        line_dedup.BROADCAST_ROWS = limit
        got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.drop_repeated_lines(docs).collect()]
        assert sorted(got, key=str) == sorted(plain(rows), key=str)
    line_dedup.BROADCAST_ROWS = 200_000


def test_repeated_rows_and_none(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "A b\tc\nd"), (None, "p q"), (None, "r s"), (3, "P Q\nr\ns r\n")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in line_dedup.drop_repeated_lines(docs).collect()), key=str)
    assert got == [(1, "a b c"), (1, "a b c"), (2, "d"), (3, "r\n"), (None, "p q"), (None, "r s")]
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_levels_are_packed(spark):
    """Every plan holds the table of levels: 16 buckets share a long."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i))) for i in range(1, 40)], "doc_id long, text string")
    levels = line_dedup._levels(docs)
    assert spark.range(1).select(F.size(levels)).first()[0] == line_dedup.BUCKETS // 16
    of = lambda w: F.shiftright(line_dedup._level(levels, F.xxhash64(F.lit(w)).bitwiseAND(F.lit(line_dedup.BUCKETS - 1).cast("long")).cast("int")), 60)
    mean = sum(range(1, 40)) / line_dedup.BUCKETS
    for word, n in (("w0", 39), ("w20", 19), ("w38", 1)):
        want = min(max(math.floor(math.log2(n / mean)) + 4, 0), 15) - 8
        assert spark.range(1).select(of(word)).first()[0] == want


def test_near_copies_take_few_pairs(spark, monkeypatch):
    """A group of n near copies is settled by its first, not by all n * n / 2 pairs; sets of all classes of size meet."""
    tables, write = [], line_dedup.materialize

    def counted(df, name):
        out = write(df, name)
        tables.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    rnd = random.Random(5)
    long, short, nested = ([f"{n}{rnd.randrange(10**6)}" for _ in range(k)] for n, k in (("a", 40), ("b", 12), ("c", 70)))
    edited = lambda base, i: " ".join(f"new{i}" if j == i % len(base) else w for j, w in enumerate(base))
    lines = [edited(base, i) for base in (long, short) for i in range(150)] + [" ".join(nested[:k]) for k in range(3, 70, 2)]
    rnd.shuffle(lines)
    rows = list(enumerate(lines))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1_000_000, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", limit, raising=False)
        got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.drop_repeated_lines(docs).collect()]
        assert sorted(got) == plain(rows)
    assert max(tables) <= 8 * len(rows)


def test_little_is_interpreted(spark, monkeypatch):
    """No lambda function stands in the generators of all lines, and no text is shuffled to lose few lines."""
    plans, write = {}, line_dedup.materialize

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(line_dedup, "materialize", seen)
    rows = [(1, "a  b\tc d e\nx y z"), (2, "E d c\x0bB a\nf"), (3, "a b c d e f"), (4, " \n"), (5, None), (6, "F")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = line_dedup.drop_repeated_lines(docs)
        got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()]
        last = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(got) == plain(rows)
    generators = [line for line in plans["lines"].splitlines() if "Generate " in line]
    assert generators and not any("lambdafunction" in line for line in generators)
    assert "SortMergeJoin" not in last
    # arrays that can't hold nulls are sorted as plain numbers
    sets = line_dedup._with_sets(line_dedup._lines(docs), line_dedup._levels(docs))
    assert not sets.schema["low"].dataType.containsNull
