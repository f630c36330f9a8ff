"""WARC archives in seekable Zstandard bundles.

A record's payload is stored once: of records with equal payloads, that with the
largest id is the response, and the others are revisits that refer to it. Tasks write
their records into bundles: groups of records are compressed as independent frames,
and a seek table in a skippable frame at the end lists the frames' sizes, as the
seekable format of Zstandard has it. An index maps each record's id to its bundle,
its frame, and its place within that frame, so one record is read by decompressing
one frame.

Bundles are named by task attempt, and the index, a table, names the bundles of the
attempts that were committed; what a lost executor left behind is never read. A task
holds one frame at a time. Payload digests are counted before the shuffle; hot
digests meet in a sort-merge join whose large partitions can be split.

A bundle begins with a frame of its own that describes it. A record's id is unique in
the archive, whatever the pages' ids; these are headers beside it, also that of the
response which a revisit's digest names.

Defined results: a null html is an empty payload; null ids stay null and are never
referred to; rows that repeat the id of their response are responses too; a very long
payload is a frame of its own, up to the 4 GB that a seek table can name, and an error
beyond; control characters in a url are percent-encoded, a null url gets no header;
further columns are ignored whatever their names; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.shared import sliced

#: Fixed by the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id long, file string, frame int, frame_at long, frame_size long, at long, size long"
RECORD = "record_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def info(name: str, date: str) -> bytes:
    """The record that a bundle begins with."""
    block = b"format: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}"]
    head += [f"WARC-Filename: {name.rsplit('/', 1)[-1]}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(record_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z", place: str = "") -> bytes:
    """One WARC record. A revisit has no block; the length of its payload is a header of its own.

    Its id is the page's, which may be null or repeat, and with place, that of the record in its archive, no other's.
    """
    urn = lambda x: f"<urn:page:{'' if x is None else x}>"
    revisit = refers_to is not None
    block = b"" if revisit else _HTTP + payload
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{place}/{record_id}')}>" if place else urn(record_id)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {own}", f"X-Page-ID: {urn(record_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if ord(c) > 31 and ord(c) != 127 else f"%{ord(c):02X}" for c in url))
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"X-Refers-To-Page-ID: {urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at a place, and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    start, size = end + 4, int(head["content-length"])
    return head, data[start : start + size], start + size + 4


class Bundle:
    """Writes frames and, when closed, the seek table."""

    def __init__(self, out: BinaryIO, level: int = 6):
        self.out, self.packer = out, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.at, self.entries = 0, []

    def frame(self, data: bytes) -> tuple[int, int, int]:
        """The frame's number, place and size; the seek table has 32 bits for a frame's length."""
        if len(data) >= 1 << 32:
            raise ValueError(f"a frame of {len(data)} bytes is too long for a seek table")
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data)))
        self.at += len(packed)
        return len(self.entries) - 1, self.at - len(packed), len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(file: BinaryIO) -> list[tuple[int, int, int]]:
    """Place, size and unpacked size of each frame."""
    size = file.seek(0, 2)
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    width = 12 if flags & 128 else 8
    file.seek(size - 9 - n * width)
    raw, at, out = file.read(n * width), 0, []
    for i in range(n):
        packed, whole = struct.unpack_from("<II", raw, i * width)
        out.append((at, packed, whole))
        at += packed
    return out


def _open(uri: str) -> BinaryIO:
    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)


def read_record(file: str, frame_at: int, frame_size: int, at: int, size: int) -> bytes:
    """One record by its entry of the index; only its frame is read."""
    with _open(file) as f:
        f.seek(frame_at)
        return zstandard.ZstdDecompressor().decompress(f.read(frame_size))[at : at + size]


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to, null for responses."""
    digest = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    twice = digest.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 AND kept IS NOT NULL").drop("n")
    joined = digest.join(twice, "digest", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 26, date: str | None = None) -> DataFrame:
    """Write the archive below folder, a URI that all executors reach; the index, kept there as a table. date: of all records, by default now."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(f"{path}/bundles", recursive=True)
        task, bundle, count, name = TaskContext.get(), None, 0, ""
        held: list[tuple[int | None, bytes]] = []

        def flush() -> pa.RecordBatch:
            nth, frame_at, size = bundle.frame(b"".join(r for _, r in held))
            at, rows = 0, []
            for i, r in held:
                rows.append((i, name, nth, frame_at, size, at, len(r)))
                at += len(r)
            held.clear()
            kinds = (pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in INDEX.split(", ")])

        pending = 0
        for batch in sliced(batches, "html"):
            for page, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle is None:
                    name = f"{folder}/bundles/{task.partitionId():06}-{task.taskAttemptId()}-{count}.warc.zst"
                    bundle, count = Bundle(where.open_output_stream(fs.FileSystem.from_uri(name)[1], compression=None)), count + 1
                    bundle.frame(info(name, date))
                held.append((page, record(page, url, html.encode(), refers_to, date, f"{name}#{bundle.at}.{len(held)}")))
                pending += len(held[-1][1])
                if pending >= frame_bytes:
                    yield flush()
                    pending = 0
                    if bundle.at >= bundle_bytes:
                        bundle.close()
                        bundle = None
        if held:
            yield flush()
        if bundle is not None:
            bundle.close()

    deduplicated(pages, least_bytes).mapInArrow(of, INDEX).write.parquet(f"{folder}/index")
    return index(pages.sparkSession, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archive's bundles. Digest and length of a response are those of the payload as read."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, number = zstandard.ZstdDecompressor(), lambda urn: int(urn[10:-1]) if urn and urn != "<urn:page:>" else None
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with _open(file) as f:
                    for place, size, _ in seek_table(f):
                        f.seek(place)
                        data, at, rows = unpack.decompress(f.read(size)), 0, []
                        while at < len(data):
                            head, block, at = parse(data, at)
                            if head["warc-type"] == "warcinfo":
                                continue
                            n, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:")
                            if head["warc-type"] == "response":
                                payload = block[block.index(b"\r\n\r\n") + 4 :]
                                if (len(payload), base32_sha1(payload)) != (n, digest):
                                    raise ValueError(f"{file} holds a damaged payload of {head['x-page-id']}")
                            rows.append((number(head["x-page-id"]), head.get("warc-target-uri"), head["warc-type"], n, digest, number(head.get("x-refers-to-page-id"))))
                        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in RECORD.split(", ")])

    files = index(spark, folder).select("file").distinct()
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(of, RECORD)


#: What the archive of pages gives back: 5 digits of SHA-1 in hexadecimal are 4 of base 32.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS top FROM p GROUP BY d),
v AS (SELECT page_id, h, top, d, list_transform(range(8), lambda i: ('0x' || substr(d, 5 * i + 1, 5))::BIGINT) AS g FROM p JOIN k USING (d))
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((g[1 + j // 4] >> (15 - 5 * (j % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM v
"""
