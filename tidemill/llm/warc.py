"""WARC records in ZIP packages.

A package is a ZIP file whose members are stored: archive/data.warc.gz (each record a gzip member of its own) and
indexes/index.cdx (a line of JSON for each record: where it lies, and what it is). Reading parses the package's
central directory, or its ZIP64 form, finds the members and the index, and reads each record by its own range: nothing
is extracted, and no more than a record is held. Packages are files in a folder that all tasks reach (by pyarrow's file
systems); a table lists those of tasks that ended, so what a lost task wrote is never read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import scratch, stored, table
from tidemill.llm.files import file_system

REVISIT_BYTES, PACKAGE_BYTES, SALTS = 1000, 4 << 20, 16
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the formats.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"


class ArchiveError(ValueError):
    pass


# --- records -------------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "None" else int(value)


def parse_record(raw: bytes) -> dict:
    """The record's fields; a response's payload is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ArchiveError("no record begins here")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ArchiveError("a payload doesn't have its digest")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": json.loads(f'"{fields["WARC-Target-URI"]}"'),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


# --- packages ------------------------------------------------------------------------------------------------------


class Package:
    """A package while it is written."""

    def __init__(self) -> None:
        self.data, self.index = io.BytesIO(), []

    def add(self, page_id: int | None, raw: bytes) -> None:
        at = self.data.tell()
        self.data.write(gzip.compress(raw, 5, mtime=0))
        self.index.append(json.dumps({"page": page_id, "offset": at, "length": self.data.tell() - at}))

    def bytes(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, body in ((DATA, self.data.getvalue()), (INDEX, "\n".join(self.index).encode())):
                with z.open(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True) as f:
                    f.write(body)
        return out.getvalue()


class ByteRanges:
    """Ranges of bytes in memory. What a store offers (seek and read) fits the same two methods."""

    def __init__(self, content: bytes):
        self.view, self.size = memoryview(content), len(content)

    def read(self, start: int, length: int) -> bytes:
        if start < 0 or length < 0 or start + length > self.size:
            raise ArchiveError("a range lies outside the package")
        return bytes(self.view[start : start + length])


class FileRanges:
    """Ranges of a seekable file."""

    def __init__(self, file: io.BufferedIOBase | pa.NativeFile):
        file.seek(0, io.SEEK_END)
        self.file, self.size = file, file.tell()

    def read(self, start: int, length: int) -> bytes:
        if start < 0 or length < 0 or start + length > self.size:
            raise ArchiveError("a range lies outside the package")
        self.file.seek(start)
        return self.file.read(length)


def directory(source: ByteRanges | FileRanges) -> dict[str, tuple[int, int, int]]:
    """Name -> (offset of the local header, stored size, CRC-32) of the stored members."""
    tail_at = max(0, source.size - 65_557)
    tail = source.read(tail_at, source.size - tail_at)
    end = tail.rfind(END)
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ArchiveError("no end of a central directory")
    count, length, at = struct.unpack("<HII", tail[end + 10 : end + 20])
    if (count == 0xFFFF or 0xFFFFFFFF in (length, at)) and tail_at + end >= 20:
        locator = source.read(tail_at + end - 20, 20)
        if locator[:4] == LOCATOR64:
            (at64,) = struct.unpack("<Q", locator[8:16])
            record64 = source.read(at64, 56)
            if record64[:4] != END64:
                raise ArchiveError("the ZIP64 end record is missing")
            count, length, at = struct.unpack("<QQQ", record64[32:56])
    raw, members, p = source.read(at, length), {}, 0
    for _ in range(count):
        if raw[p : p + 4] != CENTRAL:
            raise ArchiveError("the central directory is damaged")
        method, crc, packed, plain = struct.unpack("<H4xIII", raw[p + 10 : p + 28])
        n_name, n_extra, n_note = struct.unpack("<HHH", raw[p + 28 : p + 34])
        (header,) = struct.unpack("<I", raw[p + 42 : p + 46])
        name, extra = raw[p + 46 : p + 46 + n_name].decode(), raw[p + 46 + n_name : p + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, size = struct.unpack("<HH", extra[:4])
            if kind == 1:  # the ZIP64 values, of those fields only that are full
                values = iter(struct.unpack(f"<{size // 8}Q", extra[4 : 4 + size // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            extra = extra[4 + size :]
        if method == 0:
            members[name] = (header, packed, crc)
        p += 46 + n_name + n_extra + n_note
    return members


def member_start(source: ByteRanges | FileRanges, header: int) -> int:
    raw = source.read(header, 30)
    if raw[:4] != LOCAL:
        raise ArchiveError("a member has no local header")
    return header + 30 + sum(struct.unpack("<HH", raw[26:30]))


def records(source: ByteRanges | FileRanges) -> Iterator[dict]:
    members = directory(source)
    if DATA not in members or INDEX not in members:
        raise ArchiveError("the package lacks its archive or index")
    header, size, crc = members[INDEX]
    index = source.read(member_start(source, header), size)
    if zlib.crc32(index) != crc:
        raise ArchiveError("the index is damaged")
    header, size, _ = members[DATA]
    start = member_start(source, header)
    for line in index.splitlines():
        entry = json.loads(line)
        if entry["offset"] + entry["length"] > size:
            raise ArchiveError("a record lies outside its archive")
        yield parse_record(gzip.decompress(source.read(start + entry["offset"], entry["length"])))


# --- tables --------------------------------------------------------------------------------------------------------


def digested(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to. Null html is an empty payload. Of equal payloads of at least `least`
    bytes the largest page_id is kept (every row of it, should it repeat); a null page_id comes before all others.

    Equal payloads are counted by digest, map side first; pages meet only the digests that repeat, over SALTS salts.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least)
    repeated = large.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 AND kept IS NOT NULL").drop("n")
    repeated = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = large.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    met = salted.join(repeated, ["digest", "salt"], "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("kept")), F.lit(None)).otherwise(F.col("kept")).cast("long")
    met = met.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    small = rows.where(F.octet_length("payload") < least).withColumn("refers_to", F.lit(None).cast("long"))
    return met.unionByName(small)


def packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Packages with a record for each page, written to a folder: archive (the file), records and bytes of each. A package
    takes package_bytes of records, or one. A task that runs again writes files of other names."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        own, held = Package(), 0

        def out() -> pa.RecordBatch:
            name = f"package-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip"
            content = own.bytes()
            with system.open_output_stream(f"{base}/{name}") as f:
                f.write(content)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(own.index)], pa.int64()), pa.array([len(content)], pa.int64())], names=["archive", "records", "bytes"])

        system.create_dir(base)
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[i].as_py() for c in batch.columns)
                own.add(page_id, record(page_id, url, payload, digest, refers_to))
                held += len(payload)
                if held >= package_bytes:
                    yield out()
                    own, held = Package(), 0
        if own.index:
            yield out()

    return digested(pages).mapInArrow(write, "archive string, records long, bytes long")


FIELDS = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]


BATCH_BYTES = 1 << 20


def read_packages(archives: DataFrame) -> DataFrame:
    """A row for each record of packages (archive): FIELDS; the payload is null for revisits."""
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], t) for f, t in zip(FIELDS, types)], names=FIELDS)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = file_system(archive)
                rows, held = [], 0
                with system.open_input_file(path) as f:
                    for r in records(FileRanges(f)):
                        rows.append(r)
                        held += r["payload_bytes"]
                        if held >= BATCH_BYTES:
                            yield made(rows)
                            rows, held = [], 0
                yield made(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    # files are of about the same size: they are dealt, not their rows' few bytes
    return archives.select("archive").repartition(archives.sparkSession.sparkContext.defaultParallelism * 4, "archive").mapInArrow(read, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: pages written as packages in the shared folder, and read back by ranges."""
    folder = scratch(spark, "packages")
    archives = stored(packages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder), "packages-list")
    return read_packages(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM m
"""
