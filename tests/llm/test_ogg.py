import hashlib
import zlib

import pytest

from tidemill.llm import ogg

TEXTS = ["", None, "a", "é" * 70, "x" * 64, "long text " * 30_000, "same", "same"]


def slow_checksum(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum_against_bit_by_bit():
    for data in (b"", b"\0", b"OggS", bytes(range(256)) * 3):
        assert ogg.checksum(data) == slow_checksum(data)


def test_round_trip_and_damage():
    for text in TEXTS:
        payload, n = ogg.padded(text)
        assert len(payload) % 64 == 0 and payload and payload[:n] == (text or "").encode()
        media = ogg.write(payload, b"note")
        streams = ogg.read(media)
        assert b"".join(streams[ogg.AUDIO_SERIAL]["packets"][1:]) == payload
        assert streams[ogg.COMMENT_SERIAL]["packets"][1] == b"note"
        assert streams[ogg.AUDIO_SERIAL]["granules"][-1] == len(payload)
        for at in (30, len(media) // 2, len(media) - 1):
            with pytest.raises(ogg.OggError):
                ogg.read(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
        with pytest.raises(ogg.OggError):
            ogg.read(media[:-1])


def test_packets_go_on_over_pages():
    big = bytes(range(251)) * 2000
    streams = ogg.read(b"".join(ogg.pages(7, [(b"head", 0), (big, 5), (b"", 6), (b"x" * 255, 7)])))
    assert streams[7]["packets"] == [b"head", big, b"", b"x" * 255] and streams[7]["pages"] > 8


def plain_feature(payload, media):
    """The feature by counting one by one."""
    n, packets = len(payload), -(-len(payload) // ogg.SAMPLES_PER_PACKET)
    mean = sum(payload) * 100 // n
    variance = (sum(b * b for b in payload) * n - sum(payload) ** 2) * 100 // (n * n)
    cross = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:]))
    serials = [media[i + 14] for i in range(len(media) - 3) if media[i : i + 4] == b"OggS"]
    return f"ms={n * 1000 // 8000};mean100={mean};var100={variance};cross={cross};packets={packets};pages={serials.count(1)};streams=2"


def test_times_and_feature():
    for text in TEXTS:
        payload, _ = ogg.padded(text)
        media = ogg.write(payload, b"note")
        streams = ogg.read(media)
        assert ogg.features(payload, streams) == plain_feature(payload, media)
        ends = [min(len(payload), i + ogg.SAMPLES_PER_PACKET) for i in range(0, len(payload), ogg.SAMPLES_PER_PACKET)]
        assert ogg.packet_ends(streams[ogg.AUDIO_SERIAL]) == ends


def test_columns(spark):
    df = spark.createDataFrame([(i, t, b"mine") for i, t in enumerate(TEXTS)], "doc_id long, text string, media binary")
    rows = ogg.media_features(ogg.media_column(df, "text", ["doc_id", "media"])).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        payload, n = ogg.padded(TEXTS[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    a, b = [r for r in rows if TEXTS[r.doc_id] == "same"]
    assert a[1:] == b[1:]
    assert ogg.media_features(ogg.media_column(df.limit(0), "text", ["doc_id"])).count() == 0
