"""Nested requests: planted values at each depth are gone; a failing detector leaves no text of its row."""

import re


from tidemill.operators.privacy import detect, requests

KIND = "struct<role:string,parts:array<struct<text:string,n:int,args:map<string,array<string>>>>,meta:map<string,struct<who:string>>,tags:array<array<string>>>"
MAIL = "amy@example.com"


def row(i, at=None, word=MAIL):
    t = lambda place: f"mail {word} now" if place == at else "nothing"
    key = word if at == 5 else "k"
    return (i, (t(0), [(t(1), 3, {"a": [t(2), None], "b": None}), None, (None, None, None)], {"m": (t(3),), "x": None}, [[t(4)], None, []]), {key: 1}, "left alone")


SCHEMA = f"id long, body {KIND}, heads map<string,int>, other string"


def test_every_depth(spark):
    rows = [row(i, i) for i in range(6)] + [row(7), row(None, 0), row(None, 0), (9, None, None, None), (10, (None, None, None, None), {}, MAIL)]
    df = spark.createDataFrame(rows, SCHEMA)
    out, vault = requests.protected_requests(df, "key", ["body", "heads"])
    got = out.collect()
    assert out.columns == [*df.columns, "error"] and len(got) == len(rows)
    assert out.schema["body"].dataType.simpleString() == df.schema["body"].dataType.simpleString()
    marked = [r for r in got if re.search(r"\[\[pii:EMAIL:\w+\]\]", repr(r))]
    assert len(marked) == 8 and MAIL not in repr([(r.body, r.heads) for r in got]) and all(r.error is None for r in got)
    assert vault.count() == 1  # one name wherever it stands
    plain = {r.id: r for r in got if r.id in (7, 9, 10)}
    want = {r.id: r for r in df.collect() if r.id in (7, 9, 10)}
    assert all((plain[i].body, plain[i].heads, plain[i].other) == (want[i].body, want[i].heads, want[i].other) for i in want)
    back = str(next(r for r in got if r.id == 2)).replace(re.search(r"\[\[pii:EMAIL:\w+\]\]", repr(got))[0], MAIL)
    assert back == str(next(r for r in df.collect() if r.id == 2)).rstrip(")") + ", error=None)"


def test_failing_detectors_leave_no_text(spark):
    def broken(v):
        if "boom" in v:
            raise KeyError(v)
        return True

    rules = [*detect.RULES, detect._rule("broken", "URL", 0.9, r"(?P<v>\w*boom\w*)", broken)]
    rows = [row(1, 2), row(2, 4, "boom"), row(None, 3, "xboomy"), row(4, 0)]
    out, vault = requests.protected_requests(spark.createDataFrame(rows, SCHEMA), "key", ["body"], rules=rules)
    got = {r.id: r for r in out.collect()}
    assert {i: r.error for i, r in got.items()} == {1: None, 2: "KeyError", None: "KeyError", 4: None}
    assert got[2].body is None and got[None].body is None and got[2].other == "left alone" and "boom" not in repr(got)
    assert "[[pii:EMAIL:" in repr(got[1].body) and "[[pii:EMAIL:" in repr(got[4].body)


def test_keys_that_become_one(spark):
    df = spark.createDataFrame([(1, {"password: abcd1234": 1, "password: wxyz9876": 2}), (2, {"password: abcd1234": 1})], "id long, m map<string,int>")
    got = {r.id: r for r in requests.protected_requests(df, "key", ["m"])[0].collect()}
    assert (got[1].m, got[1].error) == (None, "DuplicateKey") and got[2].m == {"password: [[redacted:PASSWORD]]": 1}
