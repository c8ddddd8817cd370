"""WARC archives compressed with Zstandard: a dictionary frame, then one frame for each record.

Every task writes archives of its own rows, each begun anew when it has ARCHIVE_BYTES. An archive
starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a Zstandard frame
or raw; without one it starts with the first record. The reader goes through a file as a stream and
keeps one record in memory. It checks of each frame that it ends, holds one record, that the version
line and the named fields a record needs are there, and that lengths and the payload's digest are as
its headers say; what is wrong is told in `problem`, and after a broken frame the file is left.

Names of archives are new for each attempt of a task, and only those of attempts that ended well
are listed, so a lost executor leaves no half archive among them. The folder may be any that
PyArrow's file systems reach.

A page without html has an empty payload. A page without id is always a response and comes back
without id; rows with the same id and payload have the same role. Columns other than page_id, url
and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import small_batches

#: Fixed values of the formats.
SKIPPABLE_FRAMES = range(0x184D2A50, 0x184D2A60)
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

PAGE_URN = "urn:x-page:"
LEAST_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
#: The dictionary is made from at most so many pages of at most so many bytes.
SAMPLE_PAGES, SAMPLE_PAGE_BYTES = 300, 32 << 10
CHUNK = 1 << 20

MANIFEST = "path string, n_records long, n_bytes long"
RECORD = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("problem", T.StringType()),
    ]
)


def with_roles(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): of equal payloads of 1000 bytes or more all but the largest page_id refer to it."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    large = rows.filter(F.octet_length("html") >= LEAST_REVISIT_BYTES)
    # summed up before the shuffle: a payload that a third of the pages have is one row here
    kept = large.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").select("digest", "kept")
    joined = rows.join(kept, "digest", "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("page_id") < F.col("kept"), F.col("kept")).alias("refers_to"))


def train_dictionary(pages: DataFrame) -> bytes | None:
    """A dictionary from a bounded sample of pages, None if there are too few."""
    import zstandard

    fit = pages.filter(F.octet_length("html").between(1, SAMPLE_PAGE_BYTES))
    # only hashes of all pages are compared by the driver, then SAMPLE_PAGES pages are fetched
    key = F.xxhash64("page_id", "html")
    least = fit.select(key.alias("key")).distinct().orderBy("key").limit(SAMPLE_PAGES)
    rows = fit.withColumn("key", key).join(F.broadcast(least), "key", "left_semi").select("html").limit(SAMPLE_PAGES).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r.html.encode() for r in rows]).as_bytes()
    except (zstandard.ZstdError, ValueError, MemoryError):
        return None


def dictionary_frame(dictionary: bytes | None) -> bytes:
    import zstandard

    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return DICTIONARY_FRAME.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


def record_bytes(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None) -> bytes:
    name = f"{PAGE_URN}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http + (html if refers_to is None else b"")
    uri = "".join(c for c in url or "" if c not in "\r\n")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", uri),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{PAGE_URN}{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    return head + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages' records into archives below `folder`; the list of archives (path, n_records, n_bytes)."""
    small_batches(pages.sparkSession)
    dictionary = train_dictionary(pages)
    target = folder

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(target)
        system.create_dir(base, recursive=True)
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True, write_checksum=True)
        out, path, done, n, size = None, "", [], 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, n = f"{base}/{uuid.uuid4().hex}.warc.zst", 0
                    out = system.open_output_stream(path)
                    size = out.write(dictionary_frame(dictionary)) or 0
                data = packer.compress(record_bytes(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["refers_to"]))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        paths, counts, sizes = ([d[k] for d in done] for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "n_records", "n_bytes"])

    return materialize(with_roles(pages).mapInArrow(run, MANIFEST), "manifest")


class Frames:
    """The Zstandard frames of a stream, each decompressed with the dictionary at its start."""

    def __init__(self, stream):
        self.stream, self.rest, self.offset, self.dictionary = stream, b"", 0, None

    def _fill(self, n: int) -> bool:
        while len(self.rest) < n:
            more = self.stream.read(CHUNK)
            if not more:
                return False
            self.rest += more
        return True

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        """(offset, content) of each frame; ValueError for what is no frame or ends too soon."""
        import zstandard

        while self._fill(1):
            if not self._fill(4):
                raise ValueError("file ends within a frame")
            magic = int.from_bytes(self.rest[:4], "little")
            if magic in SKIPPABLE_FRAMES:
                if not self._fill(8) or not self._fill(8 + int.from_bytes(self.rest[4:8], "little")):
                    raise ValueError("file ends within a skippable frame")
                end = 8 + int.from_bytes(self.rest[4:8], "little")
                if magic == DICTIONARY_FRAME and self.offset == 0:
                    content = self.rest[8:end]
                    if content[:4] == ZSTD_FRAME.to_bytes(4, "little"):
                        content = zstandard.ZstdDecompressor().decompress(content, max_output_size=1 << 27)
                    self.dictionary = zstandard.ZstdCompressionDict(content)
                self.rest, self.offset = self.rest[end:], self.offset + end
                continue
            if magic != ZSTD_FRAME:
                raise ValueError("no Zstandard frame")
            begun, parts, read = self.offset, [], 0
            unpack = zstandard.ZstdDecompressor(dict_data=self.dictionary).decompressobj()
            try:
                while not unpack.eof:
                    if not self.rest and not self._fill(1):
                        raise ValueError("file ends within a frame")
                    parts.append(unpack.decompress(self.rest))
                    read += len(self.rest) - len(unpack.unused_data)
                    self.rest = unpack.unused_data
            except zstandard.ZstdError as error:
                raise ValueError(f"broken frame: {error}") from error
            self.offset += read
            yield begun, b"".join(parts)


def parse_record(data: bytes) -> dict:
    """The fields of one record's bytes, and `problem` if they break a rule."""
    out = dict.fromkeys(RECORD.fieldNames())
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or lines[0] != VERSION:
        return out | {"problem": "no version line or no end of headers"}
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return out | {"problem": "header without a colon"}
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if missing := [k for k in REQUIRED if not fields.get(k)]:
        return out | {"problem": f"missing {missing[0]}"}
    out |= {"record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri")}
    out |= {"page_id": _page(fields["warc-record-id"]), "refers_to": _page(fields.get("warc-refers-to", ""))}
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"problem": "content-length is not the length of the block"}
    http, blank, payload = rest[:-4].partition(b"\r\n\r\n")
    sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if not blank or len(sizes) != 1 or not sizes[0].isdigit() or algorithm != "sha1" or len(digest) != 32:
        return out | {"problem": "no payload length or digest"}
    out |= {"payload_bytes": int(sizes[0]), "payload_digest": base64.b32decode(digest).hex()}
    if out["record_type"] == "revisit":
        if out["refers_to"] is None or payload:
            return out | {"problem": "revisit with a payload or without its response"}
        return out
    if len(payload) != out["payload_bytes"] or hashlib.sha1(payload).hexdigest() != out["payload_digest"]:
        return out | {"problem": "payload is not as its length and digest say"}
    return out | {"payload": payload}


def _page(urn: str) -> int | None:
    number = urn.strip("<>").removeprefix(PAGE_URN)
    return int(number) if number.lstrip("-").isdigit() else None


def read_stream(stream, path: str = "") -> Iterator[dict]:
    frames = Frames(stream)
    try:
        for offset, data in frames:
            yield parse_record(data) | {"path": path, "offset": offset}
    except ValueError as error:
        yield dict.fromkeys(RECORD.fieldNames()) | {"path": path, "offset": frames.offset, "problem": str(error)}


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the listed archives (column `path`), checked; with or without their payloads."""
    kept = [f for f in RECORD.fields if payload or f.name != "payload"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(T.StructType(kept))
        names = schema.names
        for batch in batches:
            for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
                system, inner = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with system.open_input_stream(inner) as stream:
                    for record in read_stream(io.BufferedReader(stream, CHUNK), path):
                        rows.append({k: record[k] for k in names})
                        size += 200 + (len(record["payload"] or b"") if payload else 0)
                        if size > 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # archives are read by as many tasks as there are shuffle partitions
    spread = manifest.select("path").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(run, T.StructType(kept))
