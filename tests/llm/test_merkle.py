"""The manifest against one built by plain recursion."""

import hashlib
import zlib

import pytest
from lexigauge.llm import merkle
from lexigauge.llm.common import ascii_lower
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def folded(nodes):
    """The root of a list of digests and each one's list of (left, right)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            start = i // 16 * 16
            ways[k].append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + 16])))
        at = [i // 16 for i in at]
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], ways


def plain(rows):
    shown = [r if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 else (*r[:4], r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])) for r in rows]
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted((r[0] is not None, r[0] or 0, leaf(r), leaf(x)) for r, x in zip(rows, shown) if r[1] == s)
        trees.append((own, *folded([o[2] for o in own])))
    root, above = folded([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, sub, ways), up in zip(trees, above):
        for (known, i, a, b), way in zip(own, ways):
            node = b
            for left, right in (*way, *up):
                node = h(left, node, right)
            out.append((i if known else None, a, sub, root, h(*(x for w in (*way, *up) for x in w)), node, node == root))
    return out


def tampered():
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return {"text": F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text"))}


def check(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("tree", "idx", "n", "digest", "path")})
    out = merkle.manifest(docs.repartition(parts), altered=tampered())
    got = [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    return got


@pytest.fixture
def rows():
    out = [(i * 7 % 5000, "hot", "en", i, f"Text {i} Ünd " * (i % 4)) for i in range(700)]
    out += [(9000 + i, f"s{i % 20}", None if i % 3 else "fr", None, None if i % 5 == 0 else f"B{i}") for i in range(330)]
    out += [(20000 + i, None, "de", 3, "No source") for i in range(17)]
    out += [(None, "hot", None, None, None), (None, None, None, None, ""), (7, "hot", "en", 1, "Text 1 Ünd "), (7, "hot", "en", 1, "Text 1 Ünd ")]
    return out + [(30001, "alone", "en", 5, "One Leaf" * 30000), (30002, "", "en", 0, ""), (30003, "é", "en", 1, "X"), (30004, "z", "en", 1, "y")]


def test_proofs(spark, rows):
    got = check(spark, rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 256, 257])
def test_sizes_of_one_source(spark, n):
    check(spark, [(i, "a", "en", 1, f"T{i}") for i in range(n)])


def test_many_sources(spark):
    check(spark, [(i, f"source {i}", "en", 1, f"T{i}") for i in range(300)])
