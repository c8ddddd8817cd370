import random
import re

from lexigauge.llm import decontaminate


def plain_shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(docs, items):
    def sets(rows):
        out = {}
        for i, t in rows:
            out.setdefault(i, set()).update(plain_shingles(t))
        return out

    d, b = sets(docs), sets(items)
    return sorted(((x, y, len(d[x] & b[y]), len(b[y])) for x in d for y in b if b[y] and 5 * len(d[x] & b[y]) >= 4 * len(b[y])), key=str)


def test_pairs(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice("abcdefghijklmnop") + rnd.choice("xyzé")
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rnd.randint(1, 70))) for i in range(40)] + [(40, None), (41, ""), (None, text(20)), (3, text(10)), (5, "two words")]
    docs = [(i, text(rnd.randint(0, 300))) for i in range(30)]
    for i in range(30, 160):
        words = rnd.choice([t for _, t in items if t]).split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            words[rnd.randrange(len(words))] = word()
        docs.append((i, text(rnd.randint(0, 400)) + rnd.choice([" ", "\n", ", "]) + "".join(c.upper() if c.isascii() else c for c in " ".join(words)) + ". " + text(20)))
    docs += [(300, None), (301, ""), (302, "Two, words!"), (None, items[7][1]), (30, docs[31][1]), (31, docs[31][1])]
    want = plain(docs, items)
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int").repartition(3)
    b = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    for rows in (200_000, 0):
        decontaminate.BROADCAST_ROWS = rows
        got = [(r.doc_id, r.item_id, r.shared, r.n_shingles) for r in decontaminate.contained_items(d, b).collect()]
        assert sorted(got, key=str) == want and len(want) > 80
    decontaminate.BROADCAST_ROWS = 200_000
    assert decontaminate.contained_items(d.limit(0), b).count() == 0
    assert decontaminate.contained_items(d, b.limit(0)).count() == 0
