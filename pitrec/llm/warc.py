"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame a record.

Writing: equal payloads are found by SHA-256; the record of the smallest id is
a `response`, the others are `revisit` records that name it and carry no
payload. Each task writes archives of about `archive_mb`, as rows of a table
(name, content) in the shared folder, so that any store that Spark reaches
serves; `export` writes them as files where a path is mounted.

Reading: the dictionary frame is taken by its magic number, each frame is
decoded by itself from bounded slices, and version line, required headers,
Content-Length, block length and digests are validated; a record that breaks a
rule raises.

A null payload counts as empty; a null target gives a record without it. Each row
gives a record. One with a null id has no key and comes back with a null one: it
revisits the response of its payload, and is a response itself if no equal payload
has an id, as nothing could name it. Of repeated ids with one payload all are
responses if the id is the smallest; with different payloads each is written, and
references name the id. Empty tables give no archives. Very long payloads are one
frame each. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget_kept, scratch, table

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FEED = 1 << 14  # bytes given to the decoder at a time
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key) -> str:
    """Of a row without a key a new one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}') if key is not None else uuid.uuid4()}>"


def build_record(key, target: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record; with `refers_to` a revisit, whose block is the response head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", DATE)]
    if target:
        fields.append(("WARC-Target-URI", target.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Key", str(refers_to))]
    if key is not None:
        fields.append(("X-Key", str(key)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    return f"{VERSION}\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block; raises ValueError on a record that breaks the format."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("no end of headers")
    lines = raw[:end].decode("utf-8").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"version line {lines[0]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name:
            raise ValueError(f"header line {line!r}")
        headers[name.strip()] = value.strip()
    for name in REQUIRED:
        if name not in headers:
            raise ValueError(f"{name} is missing")
    if not headers["Content-Length"].isdigit():
        raise ValueError("Content-Length is not a number")
    length = int(headers["Content-Length"])
    if len(raw) != end + 4 + length + 4 or raw[-4:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(raw) - end - 8} bytes, Content-Length {length}")
    block = raw[end + 4 : end + 4 + length]
    if (digest := headers.get("WARC-Block-Digest")) and digest != f"sha1:{base32_sha1(block)}":
        raise ValueError("WARC-Block-Digest differs")
    return headers, block


class ArchiveWriter:
    """Collects records; `close` gives the archive's bytes."""

    def __init__(self, level: int = 6, dictionary_bytes: int = 16_384, sample: int = 64, sample_bytes: int = 4 << 20):
        self.level, self.dictionary_bytes, self.sample, self.sample_bytes = level, dictionary_bytes, sample, sample_bytes
        self.waiting: list[bytes] = []  # `sample` records, or `sample_bytes` and the one that goes beyond
        self.held = 0
        self.frames: list[bytes] | None = None
        self.size = 0

    def _start(self) -> None:
        """The first records train the dictionary; too few or too alike ones give none."""
        lead, known = b"", None
        parts = [r[:4096] for r in self.waiting]
        try:
            known = zstandard.train_dictionary(self.dictionary_bytes, parts)
            packed = zstandard.ZstdCompressor(level=19).compress(known.as_bytes())
            lead = struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed
        except zstandard.ZstdError:
            known = None
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=known, write_checksum=True, write_content_size=True)
        self.frames = [lead]
        for r in self.waiting:
            self._frame(r)
        self.waiting = []

    def _frame(self, record: bytes) -> None:
        self.frames.append(self.compressor.compress(record))
        self.size += len(self.frames[-1])

    def add(self, record: bytes) -> None:
        if self.frames is not None:
            self._frame(record)
            return
        self.waiting.append(record)
        self.held += len(record)
        if len(self.waiting) >= self.sample or self.held >= self.sample_bytes:
            self._start()

    def close(self) -> bytes:
        if self.frames is None:
            self._start()
        return b"".join(self.frames)


def read_archive(content: bytes):
    """(headers, block) of each record of one archive."""
    view, at, known = memoryview(content), 0, None
    while at + 8 <= len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 != 0x184D2A50:
            break
        if at + 8 + size > len(view):
            raise ValueError("skippable frame beyond the end")
        if magic == DICTIONARY_MAGIC and at == 0:
            raw = bytes(view[8 : 8 + size])
            if raw[:4] == FRAME_MAGIC:
                raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 24)
            known = zstandard.ZstdCompressionDict(raw)
        at += 8 + size
    decoder = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(view):
        if bytes(view[at : at + 4]) != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        one, parts = decoder.decompressobj(), []
        while not one.eof:
            part = view[at : at + FEED]
            if not len(part):
                raise ValueError("a frame is cut short")
            parts.append(one.decompress(part))
            at += len(part)
        at -= len(one.unused_data)
        yield parse_record(b"".join(parts))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_mb: int = 8) -> DataFrame:
    """(name, content): archives with a record for each row, written to the shared folder and read from there."""
    spark = pages.sparkSession
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    marks = cut(src.select("id", F.unhex(F.sha2("payload", 256)).alias("mark")))
    first = marks.groupBy("mark").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = marks.join(first, "mark").where("first is not null and not id <=> first").select(F.col("id").alias("rid"), F.col("mark").alias("rmark"), "first").distinct()
    rows = src.join(again, F.col("id").eqNullSafe(F.col("rid")) & (F.unhex(F.sha2("payload", 256)) == F.col("rmark")), "left").select("id", "url", "payload", "first")
    most = archive_mb << 20

    def write(batches):
        forget_kept()
        writer, names = None, 0

        def close():
            return pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4()}.warc.zst"]), pa.array([writer.close()], pa.binary())], names=["name", "content"])

        for batch in batches:
            for k in range(batch.num_rows):
                key, url, payload, ref = (c[k].as_py() for c in batch.columns)
                writer = writer or ArchiveWriter()
                writer.add(build_record(key, url, payload, base32_sha1(payload), ref))
                names += 1
                if writer.size >= most:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    place = f"{scratch(spark, 'warc')}/archives"
    rows.mapInArrow(write, "name string, content binary").write.option("compression", "none").parquet(place)
    return spark.read.schema("name string, content binary").parquet(place)


def read_archives(archives: DataFrame, key_type: str = "bigint") -> DataFrame:
    """(key, url, record_type, payload_digest, payload_bytes, payload, refers_to): one row a record; payload is null for revisits."""

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for headers, block in read_archive(content.as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    stated = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != stated or base32_sha1(payload) != digest):
                        raise ValueError("payload does not match its length or digest")
                    held.append((headers.get("X-Key"), headers.get("WARC-Target-URI"), kind, digest, stated, payload if kind == "response" else None, headers.get("X-Refers-To-Key")))
                    size += len(payload)
                    if size >= 8 << 20:
                        yield _records(held)
                        held, size = [], 0
                if held:
                    yield _records(held)

    found = archives.select("content").mapInArrow(read, "key string, url string, record_type string, payload_digest string, payload_bytes bigint, payload binary, refers_to string")
    return found.withColumn("key", F.col("key").cast(key_type)).withColumn("refers_to", F.col("refers_to").cast(key_type))


def _records(held: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    names = ["key", "url", "record_type", "payload_digest", "payload_bytes", "payload", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], kinds[c]) for c in range(len(kinds))], names=names)


def export(archives: DataFrame, folder: str) -> int:
    """Writes the archives as files below a mounted folder, one at a time; the number of files."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for row in archives.toLocalIterator():
        with open(os.path.join(folder, row["name"]), "wb") as f:
            f.write(row["content"])
        n += 1
    return n


def op8_warc(spark, sf_dir: str) -> DataFrame:
    found = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), f AS (
  SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, x, min(page_id) OVER (PARTITION BY h) AS first FROM p
), c AS (
  SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(x, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)) AS g FROM f
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(g, lambda v:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v // 32768 % 32 + 1 AS INTEGER), 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v // 1024 % 32 + 1 AS INTEGER), 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v // 32 % 32 + 1 AS INTEGER), 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v % 32 + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM c
"""
