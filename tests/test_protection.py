import pytest
from pyspark.sql import functions as F

from tidemill.functions import validators as V
from tidemill.operators import edits, ranking
from tidemill.operators.privacy import detect, protect
from tidemill.operators.stored import dropped, mark, stored

CARDS = [
    ("4111 1111 1111 1111", True), ("4111111111111", False), ("5555555555554444", True), ("2221000000000009", True), ("2720999999999996", True),
    ("2721000000000004", False), ("378282246310005", True), ("3782 822463 10005", True), ("6011111111111117", True), ("6500000000000002", True),
    ("3530111333300000", True), ("30569309025904", True), ("6759649826438453", True), ("4111-1111 1111-1111", False), ("0000000000000000", False), ("9111111111111111", False),
]


def test_cards_by_network(spark):
    got = [r.ok for r in spark.createDataFrame(CARDS, "v string, ok boolean").select(V.card_number(F.col("v")).alias("ok")).collect()]
    assert got == [ok for _, ok in CARDS] == [detect.card(v) for v, _ in CARDS]


def test_a_value_found_once_is_protected_everywhere(spark):
    rows = [(1, "password: hunter22 and mail bob@example.com"), (2, "then hunter22 again, xhunter22 not; call bob@example.com"), (3, None), (4, "nothing"), (5, "")]
    out, vault = protect.protected(spark.createDataFrame(rows, "id long, text string"), "id", "key")
    got = {r.id: r.text for r in out.collect()}
    assert got[1].startswith("password: [[redacted:PASSWORD]] and mail [[pii:EMAIL:")
    assert got[2].startswith("then [[redacted:PASSWORD]] again, xhunter22 not; call [[pii:EMAIL:")
    assert got[3] is None and got[4] == "nothing" and got[5] == ""
    assert [(r.identity, r.value) for r in vault.collect()] == [("EMAIL_ADDRESS", "bob@example.com")]


def test_null_and_repeated_keys_stay_protected(spark):
    rows = [(None, "mail amy@example.com now", 1), (None, "none here", 2), (7, "mail ben@example.com", 3), (7, "and amy@example.com too", 4), (8, "same cat@example.com", 5), (8, "same cat@example.com", 5)]
    df = spark.createDataFrame(rows, "id long, text string, more int")
    out, vault = protect.protected(df, "id", "key")
    got = out.collect()
    assert out.columns == df.columns and len(got) == len(rows) and not any("@" in r.text for r in got)
    assert sorted((r.id is None, r.more) for r in got) == sorted((i is None, m) for i, _, m in rows)
    assert sorted(map(repr, protect.restored(out, vault, "id").collect())) == sorted(map(repr, df.collect()))
    with pytest.raises(ValueError):
        protect.protected(df, "no_such", "key")


def test_columns_keep_rows_and_order(spark):
    rows = [(None, "amy@example.com", 30, "mail ben@example.com"), (1, "ben@example.com", 40, None), (1, None, 50, "x")]
    df = spark.createDataFrame(rows, "id long, email string, size int, notes string")
    out, _ = protect.protected_columns(df, "id", "key", ["notes", "email"])
    got = out.collect()
    assert out.columns == df.columns and len(got) == 3 and "@" not in repr(got)
    assert {r["size"]: r.notes for r in got}[30].startswith("mail [[pii:EMAIL:")


def test_columns(spark):
    rows = [(1, "bob@example.com", "call +1 202 555 0101", "Paris"), (2, "", "nothing", "Rome"), (3, None, None, None), (4, "bob@example.com", "", "Bonn")]
    df = spark.createDataFrame(rows, "id long, email string, notes string, city string")
    out, vault = protect.protected_columns(df, "id", "key", ["email", "notes", "city"])
    got = {r.id: r for r in out.collect()}
    assert got[1].email == got[4].email != "bob@example.com" and got[1].email.startswith("[[pii:EMAIL:")
    assert got[2].email == "" and got[3].email is None and got[3].notes is None
    assert got[1].notes.startswith("call [[pii:PHONE:") and got[2].notes == "nothing" and got[1].city == "Paris"
    assert {r.identity for r in vault.collect()} == {"EMAIL_ADDRESS", "PHONE_NUMBER"}


def test_hints_lose_nothing():
    """Rules that are skipped by their hints would have found nothing."""
    texts = ["PASSWORD: abcd1234", "Bearer abcdefghijklmnop1234", "CVV 123", "Exp 12/29", "Passport no. X1234567", "MRN: 12345", "DOB: 1990-01-02", "I am 44 years old", "P.O. Box 77", "Mr. Bond", "my name is Ann Lee", "Zip code: 12345", "ghp_" + "a1" * 20, "user name: bobby", "npi 1234567893"]
    for text in texts:
        bare = [s for r in detect.RULES for m in r.pattern.finditer(text) for s in [m.span("v")] if not r.check or r.check(m["v"])]
        assert detect.found(text), text
        assert {(s["start"], s["end"]) for s in detect.found(text)} <= set(bare)
    assert len([r for r in detect.RULES if r.hint]) > 25


CASES = [
    ("the password hunter22x! is old", "password-bare", "hunter22x!"), ("password protected files", None, None), ("Visa card, expires March 2027", "card-expiry-long", "March 2027"),
    ("milk expires March 2027", None, None), ("medical license number: MD-123456", "medical-license", "MD-123456"), ("device id: A1B2-C3D4", "device-id", "A1B2-C3D4"),
    ("VIN: 1M8GDM9A1KP042788", "vin-labelled", "1M8GDM9A1KP042788"), ("call 030 1234 5678 now", "phone-grouped", "030 1234 5678"), ("ratio 030 1234 5678", None, None),
    ("she lives at 12 Baker Street", "lives-at", "12 Baker Street"), ("he works for Acme Corp today", "works-at", "Acme Corp"), ("my wife Anna Lee left", "relative-name", "Anna Lee"),
    ("Dear John Smith, thanks", "greeted-name", "John Smith"), ("Dear customer", None, None), ("call 07700 900123", "phone-uk-mobile", "07700 900123"), ("call 07700 900 123", "phone-uk-mobile", "07700 900 123"), ("07700900123x", None, None),
    ("host fe80::1ff:fe23:4567:890a up", "ipv6", "fe80::1ff:fe23:4567:890a"), ("at 12:30:45 o'clock", None, None), ("mac 00:1B:44:11:3a:b7", "mac", "00:1B:44:11:3a:b7"), ("mac 00-1B:44-11:3a-b7", None, None),
    ("Ottawa K1A 0B1", "ca-postcode", "K1A 0B1"), ("Ottawa D1A 0B1", None, None), ("to P.O. Box 1234", "po-box", "P.O. Box 1234"), ("IBAN DE89 3704 0044 0532 0130 00", "iban", "DE89 3704 0044 0532 0130 00"), ("IBAN DE89370400440532013000", "iban", "DE89370400440532013000"),
    ("card 3782 822463 10005", "card", "3782 822463 10005"), ("card 4111-1111-1111-1111", "card", "4111-1111-1111-1111"), ("меня зовут Иван Петров.", "introduced-script", "Иван Петров"),
]


@pytest.mark.parametrize("text,rule,value", CASES)
def test_rules(text, rule, value):
    got = {(s["detector"], text[s["start"] : s["end"]]) for s in detect.found(text)}
    assert (rule, value) in got if rule else not got


def test_column_names(spark):
    names = {"cardExpiry": "CARD_EXPIRATION", "patient_npi": "MEDICAL_LICENSE", "home_latitude": "LOCATION", "licensePlate": "LICENSE_PLATE", "account_id": "ACCOUNT_ID", "job_title": "OCCUPATION", "o_comment": None, "flat": None, "template": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.k for r in df.select("n", detect.column_class(F.col("n")).alias("k")).collect()} == names


def test_full_ranking_and_boosts(spark):
    scores = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "id long, score double")
    want = {i: p for p, (_, i) in enumerate(sorted((-float(i % 7), i) for i in range(500)))}
    assert {r.id: r.place for r in ranking.ranked(scores, "id").collect()} == want
    assert ranking.ranked(scores.limit(0), "id").count() == 0
    assert {r.place for r in ranking.ranked(scores.where("id < 1"), "id").collect()} == {0}


def test_edits_to_null_and_of_one_row_twice(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, x string, y int")
    change = lambda rows: spark.createDataFrame(rows, "op string, k long, x string, y int, nulls array<string>")
    out = edits.applied(df, change([("update", 1, None, None, ["x"]), ("update", 1, None, 9, None), ("update", 2, "c", None, None)]), ["k"])
    assert sorted(map(tuple, out.collect())) == [(1, None, 9), (2, "c", 6)]
    with pytest.raises(edits.EditError):
        edits.applied(df, change([("update", 1, "q", None, None), ("update", 1, "r", None, None)]), ["k"])


def test_dropped_tables(spark):
    begin = mark()
    a, b = stored(spark.range(3), "one"), stored(spark.range(4), "two")
    dropped(spark, begin)
    assert b.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(a.inputFiles()[0])
