import hashlib
import io
import random

import zstandard
from lexigauge.llm import warc


def pages():
    rnd = random.Random(1)
    page = lambda n: "<p>" + " ".join(rnd.choice(["the", "of", "é", "web"]) for _ in range(n))
    bodies = [page(rnd.randint(0, 900)) for _ in range(60)]
    rows = [(i, f"http://e.x/{i}", rnd.choice(bodies)) for i in range(300)]
    rows += [(400, None, None), (401, "u", ""), (None, "u", bodies[0]), (5, "again", rows[5][2]), (402, "a\r\nb: c", "x" * 1000), (403, "u", "x" * 1000),
             (404, "u", "x" * 999), (405, "u", "x" * 999), (-7, "u", "\r\n\r\nWARC/1.1\r\n" * 300), (406, "u", "é" * 400_000)]
    return rows


def plain(rows):
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    for i, _, h in rows:
        data = (h or "").encode()
        old = i is not None and len(data) >= 1000 and i < best[h or ""]
        yield i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if old else "response", best[h or ""] if old else None


def test_round_trip(spark, tmp_path, monkeypatch):
    rows = pages()
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(4)
    for size in (32 << 20, 5000):
        monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
        written = warc.write_archives(df, str(tmp_path / f"a{size}"))
        got = warc.read_archives(written).collect()
        assert sorted([tuple(r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got], key=str) == sorted(plain(rows), key=str)
        assert not [r for r in got if r.problem]
        html = {(i, (h or "").encode()) for i, _, h in rows}
        assert all((r.page_id, bytes(r.payload)) in html for r in got if r.record_type == "response")
        assert written.agg({"n_records": "sum"}).first()[0] == len(rows)
    assert warc.read_archives(warc.write_archives(df.limit(0), str(tmp_path / "none"))).count() == 0


def test_broken_archives():
    good = warc.record_bytes(1, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), None)
    sample = [good + bytes([i % 250] * (i % 40)) for i in range(2000)]
    trained = zstandard.train_dictionary(2000, sample).as_bytes()
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained)).compress
    head = warc.dictionary_frame(trained)
    read = lambda data: list(warc.read_stream(io.BytesIO(data)))
    assert [r["problem"] for r in read(head + pack(good) + pack(good))] == [None, None]
    raw = warc.DICTIONARY_FRAME.to_bytes(4, "little") + len(trained).to_bytes(4, "little") + trained
    assert read(raw + pack(good))[0]["payload"] == b"hello"
    assert read(b"") == [] and read(head) == []
    for data in (head + pack(good)[:-3], head[:-2], head + b"abcdefgh", pack(good), b"\x28\xb5"):
        assert read(data)[-1]["problem"]
    for record in (good + good, good[:-1], good.replace(b"hello", b"jello"), good.replace(b"Length: 5", b"Length: 6"), good.replace(b"1.1\r", b"0.9\r"),
                   good.replace(b"WARC-Date", b"WARC-Dote"), good.replace(b"WARC-Type:", b"WARC-Type"), b""):
        assert read(head + pack(record))[0]["problem"], record
