"""Streams cut at every place give what the whole body gives."""

import json
import random
import re
from collections import defaultdict

from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemill.streaming import answers
from tidemill.streaming import stateful as S

PARTS = ["Hi [[pii:EMAIL:abcdef]] a", "b [[pi", "i:EMAIL:00", "0000]] [x] [", "[", "[no marker at all", " é\r\n end", "[[", "pii:A:"]


def body(parts, end='data: {"done": true}\n\n'):
    lines = ["\n\n", "\r\n\r\n", "\r\r"]
    return "".join(f"event: x{nl[: len(nl) // 2]}data: {json.dumps({'delta': p})}{nl}" for p, nl in zip(parts, lines * 9)) + ": a comment\n\ndata: no json\n\n" + end + "tail"


def test_hold_back():
    for text, n in [("a", 0), ("a[", 1), ("a[[", 2), ("a[[pii:X", 7), ("a[[pii:X:ab]", 11), ("a[[pii:X:ab]]", 0), ("[[ no", 0), ("[[pii" + "x" * 80, 0), ("", 0), ("[[pii:A:b]][", 1)]:
        assert S.held_back(text) == n, text


def test_events_cut_anywhere():
    whole = body(PARTS)
    want, rest = S.cut_events(whole)
    assert rest == "tail" and len(want) == len(PARTS) + 2
    for i in range(len(whole)):
        a, carry = S.cut_events(whole[:i])
        b, end = S.cut_events(carry + whole[i:])
        assert (a + b, end) == (want, rest), i


def test_stream_equals_whole(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for n in (1, 2, 3, 5, 17, 1000):
        b = body(PARTS)
        rows += [(f"s{n}", i, b[j : j + n]) for i, j in enumerate(range(0, len(b), n))]
    for k in range(40):  # cut at each place into two
        b = body(["x [[pii:", f"EMAIL:{k:06d}]] y"])
        i = k * len(b) // 40
        rows += [(f"c{k}", 0, b[:i]), (f"c{k}", 1, b[i:])]
    b = body(PARTS, end="")  # one that doesn't end
    rows += [("open", i, b[j : j + 9]) for i, j in enumerate(range(0, len(b), 9))]
    rows += [(None, 0, "x"), ("gap", 1, "data: {}\n\n"), ("null", 0, None), ("null", 1, 'data: {"delta": "z"}\n\ndata: [DONE]\n\n')]
    schema = "stream string, seq long, chunk string"
    rng.shuffle(rows)
    rows += rng.sample([r for r in rows if r[0] == "s3"], 20)  # some come twice
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/chunks")
    out = S.streamed(f"{tmp_path}/out", schema, f"{tmp_path}/chunks", spark, files=1).orderBy("stream", "place").collect()
    text, done = defaultdict(str), set()
    for r in out:
        text[r.stream] += r.text
        done |= {r.stream} if r.finished else set()
        assert r.finished or not re.search(r"\[\[?(pii(:[A-Z]*(:\w*)?)?)?\]?$", r.text), r
    clean = spark.createDataFrame(sorted({r for r in rows if r[0] and r[0] not in ("open", "gap", "null")}), schema)
    want = {r.stream: (r.text, r.finished) for r in answers.folded(answers.framed(clean)).collect()}
    assert {s: (text[s], s in done) for s in want} == want
    assert text["open"] == "".join(PARTS)[: -len("[[pii:A:")] and "open" not in done and "gap" not in text
    assert text["null"] == "z" and "null" in done


def test_state_goes_when_streams_end(spark, tmp_path):
    schema = "stream string, seq long, chunk string"
    b = body(["one", "two"])
    rows = [(f"s{k}", i, b[j : j + 40]) for k in range(5) for i, j in enumerate(range(0, len(b), 40))] + [("open", 0, b[:30])]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/c")
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKS)
    try:
        q = S.pieces(spark.readStream.schema(schema).parquet(f"{tmp_path}/c"), None).writeStream.format("memory").queryName("kept").option("checkpointLocation", f"{tmp_path}/k").trigger(availableNow=True).start()
        q.awaitTermination()
        left = spark.read.format("statestore").option("path", f"{tmp_path}/k").option("stateVarName", "at").load().select(F.col("key.*")).collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    assert [r[0] for r in left] == ["open"]


def test_state_is_read_once_and_written_once():
    """Whatever waits, a stream of a batch takes one read and one write of its state; one that ends at once writes none."""
    calls, kept = [], {}

    class Value:
        def get(self):
            calls.append("get")
            return kept.get("at")

        def update(self, value):
            calls.append("update")
            kept["at"] = value

        def clear(self):
            calls.append("clear")
            kept.clear()

    class Handle:
        def getValueState(self, name, schema, ttl=None):
            return Value()

    own = S.Answers()
    own.init(Handle())
    b = body(PARTS)
    rows = [Row(seq=i, chunk=b[j : j + 9]) for i, j in enumerate(range(0, len(b), 9))]
    got = []
    for part in (rows[10:], rows[2:12], rows[:2]):  # the most comes before the first
        calls.clear()
        got += [r.text for r in own.handleInputRows(("s",), iter(part), None)]
        assert len(calls) == 2 and calls[0] == "get"
    assert "".join(got) == "".join(PARTS) and not kept
    calls.clear()
    assert list(own.handleInputRows(("t",), iter(rows), None))[-1].finished and calls == ["get"]
