"""Media columns: texts as Ogg files of 8-bit samples.

Writing puts a payload into packets of SAMPLES_PER_PACKET unsigned 8-bit samples on one logical stream, and a comment
packet on a second one whose pages lie between those of the first. Reading verifies each page's checksum and sequence
number, reassembles packets from the lacing values (over pages, where they are continued), separates the logical
streams by serial number and takes times from the granule positions, which count samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD, RATE, SAMPLES_PER_PACKET, PACKETS_PER_PAGE = 64, 8000, 4096, 8
#: Fixed values of the container.
CAPTURE, CONTINUED, FIRST, LAST, HEADER = b"OggS", 1, 2, 4, struct.Struct("<4sBBqIIIB")
AUDIO_SERIAL, COMMENT_SERIAL = 1, 2
AUDIO_MAGIC, COMMENT_MAGIC = b"PCM8    ", b"Comments"

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, high bit first, from 0, not inverted: zlib's on mirrored bits."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "big").translate(_REVERSED), "little")


def _lacing(length: int) -> list[int]:
    return [255] * (length // 255) + [length % 255]


def pages(serial: int, packets: list[tuple[bytes, int]], per_page: int = PACKETS_PER_PAGE) -> list[bytes]:
    """One logical stream's pages. packets: with the granule position at each one's end. The first packet stands alone."""
    segments: list[tuple[int, bool, int, bytes]] = []  # lacing value, whether it begins a packet, granule if it ends one
    for data, granule in packets:
        values, at = _lacing(len(data)), 0
        for i, v in enumerate(values):
            segments.append((v, i == 0, granule if i == len(values) - 1 else -1, data[at : at + v]))
            at += v
    groups, current, ended = [], [], 0
    for s in segments:
        if len(current) == 255 or ended == per_page:
            groups.append(current)
            current, ended = [], 0
        current.append(s)
        ended += s[2] >= 0
        if s[2] >= 0 and not groups:
            groups.append(current)
            current, ended = [], 0
    if current:
        groups.append(current)
    out = []
    for number, group in enumerate(groups):
        flags = (not group[0][1]) * CONTINUED | (number == 0) * FIRST | (number == len(groups) - 1) * LAST
        granule = max((g for _, _, g, _ in group), default=-1)
        head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(group))
        page = head + bytes(v for v, *_ in group) + b"".join(x for *_, x in group)
        out.append(page[:22] + struct.pack("<I", checksum(page)) + page[26:])
    return out


def write(payload: bytes, comment: bytes = b"") -> bytes:
    samples = [payload[i : i + SAMPLES_PER_PACKET] for i in range(0, len(payload), SAMPLES_PER_PACKET)]
    ends = [min(len(payload), (i + 1) * SAMPLES_PER_PACKET) for i in range(len(samples))]
    audio = pages(AUDIO_SERIAL, [(AUDIO_MAGIC + struct.pack("<IBB", RATE, 1, 8), 0), *zip(samples, ends)])
    notes = pages(COMMENT_SERIAL, [(COMMENT_MAGIC, 0), (comment, 0)])
    return b"".join([audio[0], notes[0], notes[1], *audio[1:]])


def read(media: bytes) -> dict[int, dict]:
    """By serial number: packets, granules (at each packet's end, -1 where the page doesn't say), ended."""
    streams: dict[int, dict] = {}
    at, view = 0, memoryview(media)
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise OggError("a page is cut off")
        capture, version, flags, granule, serial, number, crc, count = HEADER.unpack_from(media, at)
        if capture != CAPTURE or version:
            raise OggError("no page begins here")
        body = at + HEADER.size + count
        lacing = media[at + HEADER.size : body]
        end = body + sum(lacing)
        if len(lacing) < count or end > len(media):
            raise OggError("a page is cut off")
        if checksum(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) != crc:
            raise OggError("a page's checksum is wrong")
        if flags & FIRST:
            if serial in streams:
                raise OggError("a stream begins twice")
            streams[serial] = {"packets": [], "granules": [], "open": [], "pages": 0, "ended": False}
        s = streams.get(serial)
        if s is None or s["ended"] or number != s["pages"] or bool(flags & CONTINUED) != bool(s["open"]):
            raise OggError("pages are missing or out of order")
        s["pages"] += 1
        ended = 0
        for v in lacing:
            s["open"].append(view[body : body + v])
            body += v
            if v < 255:
                s["packets"].append(b"".join(s["open"]))
                s["granules"].append(-1)
                s["open"] = []
                ended += 1
        if ended:
            s["granules"][-1] = granule
        s["ended"] = bool(flags & LAST)
        at = end
    if any(s["open"] or not s["ended"] for s in streams.values()):
        raise OggError("a stream has no end")
    return streams


def packet_ends(stream: dict) -> list[int]:
    """The sample at which each packet after the head ends: what a page's granule position says of its last packet, less
    the samples of those that follow on the page."""
    ends, at = [], 0
    for packet, granule in zip(stream["packets"][:0:-1], stream["granules"][:0:-1]):
        at = granule if granule >= 0 else at
        ends.append(at)
        at -= len(packet)
    return ends[::-1]


def features(samples: bytes, streams: dict[int, dict]) -> str:
    """Length in ms by the last granule position, mean, spread and crossings of the samples, packets and pages."""
    x = np.frombuffer(samples, np.uint8)
    audio = streams[AUDIO_SERIAL]
    ms = packet_ends(audio)[-1] * 1000 // RATE
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    counts = np.bincount(x, minlength=256).tolist()
    total = sum(v * n for v, n in enumerate(counts))
    square = sum(v * v * n for v, n in enumerate(counts))
    variance = (square * len(x) - total * total) * 100 // (len(x) * len(x))
    return f"ms={ms};mean100={total * 100 // len(x)};var100={variance};cross={crossings};packets={len(audio['packets']) - 1};pages={audio['pages']};streams={len(streams)}"


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % PAD if raw else PAD), len(raw)


def media_column(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep columns, n_bytes and media (the Ogg file) of each row. Null text counts as empty. Rows stay as they are."""
    keep = [c for c in (keep if keep is not None else df.columns) if c not in ("media", "n_bytes")]
    pick = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                made = [padded(t) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([n for _, n in made], pa.int64()), pa.array([write(p, b"n_bytes=%d" % n) for p, n in made], pa.binary())], names=[*keep, "n_bytes", "media"])

    return pick.mapInArrow(store, pick.drop("__text").selectExpr("*", "0L AS n_bytes", "X'' AS media").schema)


def media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Each row of df without its media, and what is read back from it; packet_ms is when each packet ends. A damaged file
    raises OggError."""
    keep = [c for c in df.columns if c != media]
    pick = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{media}`").alias("__media"))
    added = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("packet_ms", pa.list_(pa.int64()))])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                rows = []
                for m in part.column(part.num_columns - 1).to_pylist():
                    streams = read(m)
                    samples = b"".join(streams[AUDIO_SERIAL]["packets"][1:])
                    rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-PAD:]), len(m), hashlib.sha256(m).hexdigest(), features(samples, streams), [e * 1000 // RATE for e in packet_ends(streams[AUDIO_SERIAL])]))
                cols = list(zip(*rows)) or [[]] * len(added)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(c, f.type) for c, f in zip(cols, added)]], names=[*keep, *added.names])

    return pick.mapInArrow(load, pick.drop("__media").selectExpr("*", "0L AS payload_bytes", "'' AS payload_sha256", "0L AS tail_crc32", "0L AS media_bytes", "'' AS media_sha256", "'' AS feature", "array(0L) AS packet_ms").schema)


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def op10_ogg(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document stored as Ogg, read back and described."""
    from tidemill.llm.common import table

    docs = table(spark, sf_dir, "documents")
    out = media_features(media_column(docs, "text", ["doc_id"]))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
