"""Damaged markers: each single edit is found; slices and clips never cut one."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import stored
from tidemill.operators.privacy import markers as M
from tidemill.operators.privacy import protect

SOME = ["[[pii:EMAIL:a1b2c3]]", "[[pii:PERSON:0123456789abcdef01234567]]", "[[redacted:PASSWORD]]", "[[masked:CARD:1111]]", "[[masked:CARD]]"]


def edits(marker):
    for i in range(len(marker)):
        yield marker[:i] + marker[i + 1 :]
        for c in "#x":
            yield marker[:i] + c + marker[i + 1 :]
            if i:
                yield marker[:i] + c + marker[i:]


@pytest.mark.parametrize("marker", SOME)
def test_each_single_edit_is_found(marker):
    for form in edits(marker):
        text = f"Ask {form} now, or ({form})."
        left = [m for m in M._PARTS.finditer(text) if M.sound(m)]  # another marker by this edit
        got = M.bent(text)
        assert len(got) + len(left) == 2, (form, got)
        for s, e, says in got:
            assert M._PARTS.fullmatch(says), says
            assert says[:2] == "[[" and abs(len(says) - len(marker)) <= 2
            # what is left of the damage is at most the letter that took an outer bracket's place
            assert text[max(0, s - 1) : s] in (" ", "(", "#", "x", "[") and text[e : e + 1] in (" ", ")", "#", "x", "]")


def test_prose_is_no_marker():
    for text in ["masked: yes", "pii: none", "see [[1]] and [[note:here]]", "a[[b]]c", "[[", "]]", "", "[[pii:", "list[[pii:x]]", "redacted:", SOME[0], SOME[4] * 3]:
        assert M.bent(text) == [], text


def test_columns(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice([*SOME, "word ", "[[", "]", " [x] ", "é"]) for _ in range(6)), rng.randint(0, 90)) for i in range(300)] + [(900, None, 3), (901, "", 3)]
    df = spark.createDataFrame(rows, "id long, text string, most int")
    got = {r.id: r for r in df.select("*", M.places(F.col("text")).alias("p"), M.covered(F.col("text")).alias("c"), M.safe_slice(F.col("text"), F.col("most")).alias("s")).collect()}
    import re

    for i, text, most in rows:
        if text is None:
            assert got[i].s is None
            continue
        want = [m.span() for m in re.finditer(protect.MARKER, text)]
        assert [tuple(p) for p in got[i].p] == want
        assert got[i].c == re.sub(protect.MARKER, lambda m: M.FILLER * len(m[0]), text)
        cut = next((a for a, b in want if a < most < b), most)
        assert got[i].s == text[:cut], (text, most)


def test_clips(spark):
    text = "mail  [[pii:EMAIL:a1b2c3]] or [[redacted:PASSWORD]]"
    spans = [(0, 4), (0, 8), (6, 10), (3, 50), (4, 9), (25, 28), (26, 40), (20, 28)]
    df = spark.createDataFrame([(text, [(a, b, "t") for a, b in spans])], "text string, spans array<struct<start:int,end:int,type:string>>")
    got = df.select(M.clipped(F.col("spans"), F.col("text")).alias("s")).first().s
    assert [(s.start, s.end) for s in got] == [(0, 4), (0, 4), (3, 4), (26, 29)]


def test_mended_and_restored(spark):
    vault = spark.createDataFrame([("EMAIL_ADDRESS", "amy@x.org", "a1b2c3"), ("EMAIL_ADDRESS", "ben@x.org", "a1b2c4"), ("PERSON_NAME", "Ann", "0" * 24)], "identity string, value string, pseudonym string")
    rows = [
        (1, "to [[pii:EMAIL:a1b2c3] ok", "to amy@x.org ok"),
        (None, "to [pii:EMAIL:a1b2c4]] ok", "to ben@x.org ok"),
        (None, "to [[pii:EMAIL:a1b2c#]] ok", "to [[pii:EMAIL:a1b2c#]] ok"),  # may be either
        (2, "[[pii:PERSN:" + "0" * 24 + "]] and [[pi:PERSON:" + "0" * 24 + "]]", "Ann and Ann"),
        (2, "[[pii:PERSON:" + "0" * 23 + "]]", "Ann"),
        (3, "[[redacted:PASSWORD]", "[[redacted:PASSWORD]"),
        (4, None, None),
    ]
    df = spark.createDataFrame(rows, "id long, text string, want string")
    out = protect.restored(M.mended(df, vault, "id"), vault, "id").collect()
    assert len(out) == len(rows) and all(r.text == r.want for r in out), out


def test_vaults_are_not_broadcast(spark, tmp_path, monkeypatch):
    """However small their files look: a vault's ids are exploded, and it may have a row for each text."""
    monkeypatch.setattr(stored, "FEW", 0)  # else up to that many keys may be
    texts = spark.range(30).selectExpr("id", "concat('to [[pii:PERSON:', substring(sha2(cast(id AS string), 256), 1, 24), ']') AS text")
    texts.write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    vault = texts.selectExpr("'PERSON_NAME' AS identity", "concat('name ', id) AS value", "regexp_extract(text, '([0-9a-f]{24})', 1) AS pseudonym")
    out = protect.restored(M.mended(texts, vault, "id"), vault, "id")
    assert {r.id: r.text for r in out.collect()} == {i: f"to name {i}" for i in range(30)}
    assert "Broadcast" not in out._jdf.queryExecution().toString()
