"""Vaults merged in any order are one; statements through pseudonyms give what the plain ones do."""

import pytest
from pyspark.sql import functions as F

from tidemill.operators.privacy import protect
from tidemill.operators.privacy import vault as V


def rows(df):
    return sorted(map(tuple, df.collect()))


def batch(spark, values):
    return V.named(spark.createDataFrame(values, "type string, value string, rehydrate boolean"), "key")


def test_merge(spark):
    a = batch(spark, [("PERSON_NAME", f"n{i}", True) for i in range(50)] + [("EMAIL_ADDRESS", "x@y.org", True), ("EMAIL_ADDRESS", None, True)])
    b = batch(spark, [("RELATIVE_NAME", f"n{i}", i != 40) for i in range(30, 80)] + [("EMAIL_ADDRESS", "n1", None)])
    c = batch(spark, [("PERSON_NAME", "n1", None), ("PHONE_NUMBER", "1", False)])
    whole = rows(V.merged(V.merged(a, b), c))
    assert whole == rows(V.merged(b, V.merged(c, a))) == rows(V.merged(V.merged(c, b), V.merged(a, a)))
    assert len(whole) == 83 and {r[1] for r in whole if not r[3]} == {"n40", "1"}
    names = {(r[0], r[1]): r[2] for r in whole}
    assert all(names[r[0], r[1]] == r[2] for x in (a, b, c) for r in rows(x))  # no name has changed
    assert len({(r[0], r[2]) for r in whole}) == 83


def test_withheld(spark):
    a = spark.createDataFrame([("PASSWORD", "x", "redact"), ("CREDIT_CARD_NUMBER", "4", "mask"), ("CITY", "Bonn", "preserve"), ("PASSWORD", None, "redact")], "type string, value string, action string")
    b = spark.createDataFrame([("CREDIT_CARD_NUMBER", "4", "redact")], a.schema)
    got = [rows(V.merged_withheld(V.withheld(x), V.withheld(y))) for x, y in ((a, b), (b, a))]
    assert got[0] == got[1] == [("CREDIT_CARD_NUMBER", "4", "redact"), ("PASSWORD", "x", "redact")]


def test_adopt_and_resolve(spark):
    vault = batch(spark, [("PERSON_NAME", "Ann", True), ("PERSON_NAME", "Ben", False)])
    own = {r.value: r.pseudonym for r in vault.collect()}
    history = [("RELATIVE_NAME", "Ann", "aaaaaa"), ("PERSON_NAME", "Ann", own["Ann"]), ("PERSON_NAME", "Cleo", own["Ben"]), ("PERSON_NAME", "Cleo", "bbbbbb"), ("PERSON_NAME", "Dan", "cccccc"), ("PERSON_NAME", "Eve", "cccccc"), ("PERSON_NAME", "Ben", "dddddd"), ("PERSON_NAME", None, "eeeeee")]
    new, outcome = V.adopted(vault, spark.createDataFrame(history, "type string, value string, pseudonym string"))
    assert {r.pseudonym: r.outcome for r in outcome.collect()} == {"aaaaaa": "added", own["Ann"]: "same", own["Ben"]: "conflict", "bbbbbb": "added", "cccccc": "conflict", "dddddd": "added"}
    tokens = spark.createDataFrame([("PERSON", p) for p in ("aaaaaa", own["Ann"], own["Ben"], "bbbbbb", "cccccc", "dddddd")], "tag string, pseudonym string")
    assert {r.pseudonym: r.value for r in V.resolved(new, tokens).collect()} == {"aaaaaa": "Ann", own["Ann"]: "Ann", own["Ben"]: None, "bbbbbb": "Cleo", "cccccc": None, "dddddd": None}
    text = spark.createDataFrame([(1, f"[[pii:PERSON:aaaaaa]] and [[pii:PERSON:{own['Ann']}]]")], "id long, text string")
    assert protect.restored(text, new.where("rehydrate"), "id").first().text == "Ann and Ann"


EVIL = ["O'Neil", "a'; DROP TABLE x; --", 'q"uote', "back\\slash", "50% off_all", "new\nline", "' OR '1'='1"]


def test_statements(spark):
    people = spark.createDataFrame([(i, v) for i, v in enumerate(EVIL)] + [(90, "50x offyall"), (91, "plain")], "id long, who string")
    people.createOrReplaceTempView("vault_people")
    vault = V.named(people.select(F.lit("PERSON_NAME").alias("type"), F.col("who").alias("value")), "key").cache()
    mark = {r.value: f"[[pii:PERSON:{r.pseudonym}]]" for r in vault.collect()}
    for i, v in enumerate(EVIL):
        for sql in (
            "SELECT id FROM vault_people WHERE who = '{}'",
            "SELECT id FROM vault_people WHERE who LIKE '{}%'",
            "SELECT id FROM vault_people WHERE who IN ('none', '{}')",
            'SELECT id FROM (SELECT * FROM vault_people WHERE who = "{}") s',
            "WITH a AS (SELECT * FROM vault_people WHERE who = '{}') SELECT id FROM a",
            "SELECT id FROM vault_people p WHERE EXISTS (SELECT 1 FROM vault_people q WHERE q.id = p.id AND q.who = '{}')",
            "SELECT id FROM vault_people WHERE concat('<', who, '>') = '<{}>' ORDER BY id",
            "SELECT p.id FROM vault_people p JOIN vault_people q ON p.id = q.id AND q.who = '{}'",
        ):
            assert [r.id for r in V.opened(spark, sql.format(mark[v]), vault).collect()] == [i], (sql, v)
    both = f"SELECT id, '{mark[EVIL[0]]} or {mark[EVIL[1]]}' AS x FROM vault_people WHERE who = '{mark[EVIL[1]]}'"
    assert [tuple(r) for r in V.opened(spark, both, vault).collect()] == [(1, f"{EVIL[0]} or {EVIL[1]}")]
    for sql in (f"SELECT id AS `{mark['plain']}` FROM vault_people", "SELECT '[[pii:PERSON:ffffff]]'", "SELECT '[[redacted:PASSWORD]]'", f"SELECT 1 -- {mark['plain']}", f"CREATE TABLE z AS SELECT '{mark['plain']}' AS x"):
        with pytest.raises(ValueError):
            V.opened(spark, sql, vault)
