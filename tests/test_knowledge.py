"""Facts, recall and known values against plain versions."""

import random

from pyspark.sql import functions as F

from tidemill.operators import knowledge as K
from tidemill.operators.privacy import values as V
from tidemill.operators.usage import TRUST


def fold(events):
    out = {}
    initial, ceiling = {r[1]: r[2] for r in TRUST}, {r[1]: r[3] for r in TRUST}
    for name, meaning, rank, _ in sorted(events, key=lambda e: (e[0], e[3], e[2], e[1])):
        s = out.setdefault(name, {"meaning": None, "rank": -1, "confidence": 0.0, "confirmed": 0, "refused": 0, "replaced": []})
        if s["meaning"] == meaning:
            s["rank"] = max(s["rank"], rank)
            s["confidence"] = min(ceiling[s["rank"]], s["confidence"] + K.CONFIRMED)
            s["confirmed"] += 1
        elif rank >= s["rank"]:
            if s["meaning"] is not None:
                s["replaced"] = (s["replaced"] + [s["meaning"]])[-K.HISTORY :]
            s.update(meaning=meaning, rank=rank, confidence=initial[rank])
        else:
            s["refused"] += 1
    return out


def test_learnt_facts(spark):
    rng = random.Random(3)
    events = [(rng.choice("abc"), rng.choice("uvwxyz"), rng.randint(0, 3), i) for i in range(120)]
    want = fold(events)
    for r in K.learnt(spark.createDataFrame(events, "name string, meaning string, rank int, ts int")).collect():
        s = want.pop(r.name)
        assert (r.meaning, r["rank"], r.confirmed, r.refused, r.replaced) == (s["meaning"], s["rank"], s["confirmed"], s["refused"], s["replaced"]) and abs(r.confidence - s["confidence"]) < 1e-9
    assert not want


def test_outline(spark):
    tables = spark.createDataFrame([(n,) for n in ("order_items", "orderHistory", "user_names", "user_mails", "invoices", "alone")], "name string")
    edges = spark.createDataFrame([("invoices", "a", "order_items", "b"), ("invoices", "a", "orderHistory", "b"), ("invoices", "a", "user_mails", "b")], "from_table string, from_column string, to_table string, to_column string")
    assert {tuple(r) for r in K.outline(tables, edges).collect()} == {("order_items", "order"), ("orderHistory", "order"), ("user_names", "user"), ("user_mails", "user"), ("invoices", "order")}


def test_recall(spark):
    words = F.array(F.lit("churn"), F.lit("user"))
    rules = spark.createDataFrame([("r1", ["churn"], 0.5, 1.0), ("r2", ["churn", "user"], 0.1, 0.0), ("r3", ["other"], 0.9, 9.0)], "name string, tokens array<string>, confidence double, weight double")
    assert [r.name for r in K.recalled_rules(rules, words).collect()] == ["r2", "r1"]
    values = spark.createDataFrame([("New York", "city", 2.0), ("york", "name", 3.0), ("ny", "code", 9.0)], "value string, column string, weight double")
    assert [r.value for r in K.recalled_values(values, F.lit("Sales in new york?")).collect()] == ["york", "New York"]
    links = spark.createDataFrame([("a", "b", "join", 9.0), ("b", "c", "feeds", 1.0), ("x", "y", "feeds", 5.0)], "a string, b string, kind string, weight double")
    assert [r.kind for r in K.recalled_flows(links, spark.createDataFrame([("b",)], "table string")).collect()] == ["feeds", "join"]
    queries = spark.createDataFrame([("s1", ["user"], 3, 0, 0.1, None), ("s2", ["user", "churn"], 3, 3, 0.1, "q"), ("s3", ["zzz"], 3, 1, 0.2, "q"), ("s4", ["churn", "user"], 1, 0, 0.0, None)], "shape string, tokens array<string>, runs int, errors int, weight double, question string")
    assert [r["shape"] for r in K.recalled_examples(queries, words, spark.createDataFrame([("s4",)], "shape string")).collect()] == ["s3", "s1"]
    ranked = spark.createDataFrame([("t1", 2.0), ("t2", 1.0)], "table string, score double")
    shown, columns = spark.createDataFrame([("t1",)], "table string"), spark.createDataFrame([("t3", "user_id"), ("t1", "user_id"), ("t4", "x")], "table string, column string")
    assert sorted(map(tuple, K.found_again(ranked, shown, columns, ["User"]).collect())) == [("t2", 1.0), ("t3", 0.0)]
    assert K.rendered(spark.createDataFrame([("b", "B"), ("a", "A")], "table string, line string")).first().text == "A\nB"


def test_values(spark):
    assert [(k, t[a:b]) for t in ['{"email": "a@b.cc", "size": "9"}', "x\nPhone: 555 1234\n", "WHERE first_name = 'O''Neil'", "city=Paris&n=3", "plain"] for a, b, k in V.labelled(t)] == [("EMAIL_ADDRESS", "a@b.cc"), ("PHONE_NUMBER", "555 1234"), ("PERSON_NAME", "O''Neil"), ("CITY", "Paris")]
    df = spark.createDataFrame([(1, "city=Paris"), (2, None)], "k int, text string")
    assert [tuple(r) for r in V.labelled_values(df, "k").collect()] == [(1, 5, 10, "CITY", "Paris")]
    texts = spark.createDataFrame([(1, "Ann Lee met Ann Lee, not Ann Leeds or xAnn Lee."), (2, "a.b(c) a.b(c)d"), (3, None)], "k int, text string")
    known = spark.createDataFrame([("Ann Lee", "PERSON_NAME"), ("a.b(c)", "X"), ("An", "X")], "value string, type string")
    assert {tuple(r) for r in V.known_values(texts, known, "k").collect()} == {(1, "Ann Lee", "PERSON_NAME", 2), (2, "a.b(c)", "X", 1)}
    col = spark.createDataFrame([(f"u{i}@x.org",) for i in range(9)] + [("none",)], "c string")
    assert V.inferred_column(col, "c").first().type == "EMAIL_ADDRESS" and V.inferred_column(col.limit(1), "c").count() == 0
    found = spark.createDataFrame([("Orders", 1), ("Ann", 2)], "value string, n int")
    assert [r.value for r in V.without_identifiers(found, spark.createDataFrame([("orders",)], "name string")).collect()] == ["Ann"]
    text = "a [[pii:EMAIL:0a1b2c]] b [[redacted:CVV]] [[pii:x]]"
    assert [tuple(m) for m in spark.range(1).select(V.markers(F.lit(text)).alias("m")).first().m] == [("pii", "EMAIL"), ("redacted", "CVV")]


def test_greedy_spans(spark):
    rng = random.Random(8)
    rows = [(g, a, a + rng.randint(1, 6), rng.randint(0, 100) / 100, "l") for g in range(30) for a in (rng.randint(0, 30) for _ in range(12))]
    df = spark.createDataFrame(rows, "g int, start int, end int, score double, label string")
    got = df.groupBy("g").agg(V.greedy(F.collect_list(F.struct("start", "end", "score", "label"))).alias("s")).collect()
    for r in got:
        kept = []
        for s in sorted((x for x in rows if x[0] == r.g and x[3] > 0.5), key=lambda x: (-x[3], x[1])):
            if all(s[2] <= k[1] or k[2] <= s[1] for k in kept):
                kept.append(s)
        assert sorted((x.start, x.score) for x in r.s) == sorted((k[1], k[3]) for k in kept)


def test_cache(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string")
    cache = spark.createDataFrame([("m", "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"), ("other", "e9d71f5ee7c92d6dc9e92ffdad17b8bd49418f98")], "model string, key string")
    assert [r.text for r in K.uncached(texts, cache, "m").collect()] == ["b"]
