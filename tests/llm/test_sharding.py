import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from lexigauge.llm import queries, sharding


def test_shards(spark, tmp_path):
    rows = [(i if i % 9 else None, "x" * (i % 50), i % 3) for i in range(1000)] + [(5, "same", 1)] * 300 + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(5)
    out = sharding.shuffled_shards(df, 16, bucket_bytes=5000)
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((a, b) for a, b, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    path = str(tmp_path / "shards")
    sharding.write_shards(df, path, 4)
    back = spark.read.parquet(path)
    assert back.count() == len(rows) and back.select(F.countDistinct("shard")).first()[0] == 4


def test_order_is_mixed_and_repeatable(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    order = lambda: [r.doc_id for r in sharding.shuffled_shards(df, 1, bucket_bytes=20_000).orderBy("slot").collect()]
    first = order()
    assert first == order() and sorted(first) == list(range(4000))
    # neighbours in the input are far apart: the mean step of a random order is a third of the length
    assert 1100 < sum(abs(a - b) for a, b in zip(first, first[1:])) / 3999 < 1550


def test_few(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shuffled_shards(df).count() == 0
    one = sharding.shuffled_shards(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [(r.shard, r.slot) for r in one] == [(0, 0)]


def test_query_shuffles_and_reads_back_whole_rows(spark, tmp_path, monkeypatch):
    """The query's texts go through the buckets and the shards: long ones, null ones and many equal ones."""
    texts = ["long é " * 100_000, None, ""] + ["equal text"] * 2000 + [f"text {i} é" for i in range(500)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    given, write = [], sharding.write_shards

    def seen(df, path, *args):
        given.append((df.columns, path))
        return write(df, path, *args, bucket_bytes=20_000)

    monkeypatch.setattr(sharding, "write_shards", seen)
    out = queries.op5_sharding(spark, str(tmp_path))
    got = {r.doc_id: (r["size"], r.text_crc32, r.shard, r.slot) for r in out.collect()}
    [(columns, path)] = given
    assert columns == ["doc_id", "text", "lang", "source", "n_chars"]
    back = spark.read.parquet(path).collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in back) == Counter(rows)
    for r in back:
        data = (r.text or "").encode()
        assert got[r.doc_id] == (len(data) + 1, zlib.crc32(data), r.shard, r.slot)
    assert out.count() == len(rows) and [f.split("/shard=")[0].rsplit("/", 1)[1] for f in out.inputFiles()[:1]] == ["shards"]
