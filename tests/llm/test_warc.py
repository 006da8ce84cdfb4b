import hashlib
import io
import random
import struct
import zipfile

import pytest

from tidemill.llm import warc


def package(n=3):
    p = warc.Package()
    for i in range(n):
        body = f"<p>{i}</p>".encode() * 50
        p.add(i, warc.record(i, f"http://x/{i}?é\n", body, hashlib.sha1(body).hexdigest(), None))
    return p.bytes()


def as_zip64(raw: bytes) -> bytes:
    """The same package with its directory known only by the ZIP64 records."""
    end = raw.rfind(warc.END)
    count, length, at = struct.unpack("<HII", raw[end + 10 : end + 20])
    end64 = warc.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, at)
    locator = warc.LOCATOR64 + struct.pack("<IQI", 0, end, 1)
    return raw[:end] + end64 + locator + warc.END + struct.pack("<HHHHIIH", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


def test_package_is_a_zip_file_and_reads_back():
    raw = package()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.namelist() == [warc.DATA, warc.INDEX] and z.testzip() is None
    for source in (warc.ByteRanges(raw), warc.FileRanges(io.BytesIO(raw)), warc.ByteRanges(as_zip64(raw))):
        assert [(r["page_id"], r["url"], r["payload_bytes"]) for r in warc.records(source)] == [(i, f"http://x/{i}?é\n", 400) for i in range(3)]


def test_only_ranges_are_read():
    """A first record takes the directory, the index and its own bytes; all records take each byte of the archive once."""
    reads = []

    class Counted(warc.FileRanges):
        def read(self, start, length):
            reads.append((start, length))
            return super().read(start, length)

    p = warc.Package()
    for i in range(300):
        body = random.Random(i).randbytes(3000)
        p.add(i, warc.record(i, "u", body, hashlib.sha1(body).hexdigest(), None))
    raw = p.bytes()
    found = warc.records(Counted(io.BytesIO(raw)))
    next(found)
    assert sum(n for _, n in reads) < len(raw) / 5
    assert len(list(found)) == 299
    data = sorted((a, n) for a, n in reads if 2000 < n < 10_000 and a < len(p.data.getvalue()))
    assert len(data) == 300 and all(a + n <= b for (a, n), (b, _) in zip(data, data[1:]))


def test_damage_is_noticed():
    raw = package()
    for bad in (b"", raw[:-1], raw[: len(raw) // 2], raw[:120] + bytes(255 - b for b in raw[120:130]) + raw[130:]):
        with pytest.raises((warc.ArchiveError, OSError, EOFError, warc.zlib.error)):
            list(warc.records(warc.ByteRanges(bad)))


def test_pages(spark, tmp_path):
    rng = random.Random(3)
    big = ["b" * 1000, "é" * 500, "x" * 999, "", None, "long " * 9000]
    rows = [(i, f"u{i}", rng.choice(big), "mine") for i in range(300)] + [(299, "again", big[0], ""), (None, None, big[0], None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    kept = {}
    for i, _, h, _ in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            kept[h] = max(kept.get(h, -1), i)
    expected = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        refers = kept[h] if len(raw) >= 1000 and i != kept[h] else None
        expected.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    got = [tuple(r) for r in warc.op7_warc(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    folder = str(tmp_path / "packages")
    assert warc.read_packages(warc.packages(df.limit(0), folder)).count() == 0
    made = warc.packages(df, folder, 50_000).collect()
    assert len(made) > 3 and sum(r.records for r in made) == len(rows)
    with zipfile.ZipFile(made[0].archive) as z:
        assert z.testzip() is None
