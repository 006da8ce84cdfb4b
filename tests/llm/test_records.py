"""Records: checksums against a plain one, exact round trips, order, damage."""

import os
import zlib

import numpy as np
import pytest

from tidemill.llm import records as R
from tidemill.llm.packing import word_vocabulary


def plain_crc(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (R.POLYNOMIAL * (c & 1))
    return c ^ 0xFFFFFFFF


def test_checksums():
    crc = R.Crc32c()
    assert crc([b"123456789", b"\0" * 32]).tolist() == [0xE3069283, 0x8A9136AA]  # published values
    some = [os.urandom(n) for n in (0, 1, 3, 4, 5, 8, 31, 32, 33, 500, 2049)]
    assert crc(some).tolist() == [plain_crc(m) for m in some]
    c = plain_crc(b"abc")
    assert crc.masked([b"abc"])[0] == ((c >> 15 | c << 17) + R.MASK) & 0xFFFFFFFF


def test_framing_and_damage():
    crc = R.Crc32c()
    payloads = [R.payload(5, np.array([1, 2, 3])), R.payload(None, np.array([70_000, 1])), R.payload(-4, np.array([], np.uint32))]
    data = R.framed(payloads, crc)
    lengths = [len(p) for p in payloads]
    assert R.unframed(data, lengths, crc) == payloads
    assert [(d, ids.tolist()) for d, ids in map(R.parsed, payloads)] == [(5, [1, 2, 3]), (None, [70_000, 1]), (-4, [])]
    for at in range(len(data)):
        bent = data[:at] + bytes([data[at] ^ 4]) + data[at + 1 :]
        with pytest.raises(R.RecordError):
            R.unframed(bent, lengths, crc)


def expected(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_vocabulary())
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip_on_edges(spark, tmp_path):
    rows = [(i * 7 % 40, f"Some text, number {i}! " * (i % 9)) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "long words " * 30_000), (None, "no id"), (53, "copy"), (53, "copy"), (-3, "negative")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        files = R.written(df, f"file://{tmp_path}/a", word_vocabulary, file_bytes=500)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert files.count() > 2
    listed = R.entries(files)
    got = R.read_records(listed).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == expected(rows)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    # any order gives the same records; a seed gives the same order
    again = [r.start for r in R.read_records(R.shuffled(listed, 7), ids=False).collect()]
    assert sorted(again) == sorted(r.start for r in got) and again != sorted(again)
    assert again == [r.start for r in R.read_records(R.shuffled(listed.repartition(3), 7), ids=False).collect()]


def test_damaged_file_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
    files = R.written(df, f"file://{tmp_path}/b", word_vocabulary)
    path = files.first().file.removeprefix("file://")
    data = open(path, "rb").read()
    open(path, "wb").write(data[:20] + bytes([data[20] ^ 1]) + data[21:])
    with pytest.raises(Exception, match="checksum"):
        R.read_records(R.entries(files)).collect()
    none = R.written(df.limit(0), f"file://{tmp_path}/c", word_vocabulary)
    assert R.read_records(R.entries(none)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in R.op12_records(spark, sf).collect()), key=lambda r: r[1])
    assert got == expected(rows)
