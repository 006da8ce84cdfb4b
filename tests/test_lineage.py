"""Lineage of views and statements against lists written by hand; closures against a plain search."""

import datetime
import random

import pytest

from tidemill.operators import lineage


@pytest.fixture(scope="module")
def views(spark):
    spark.createDataFrame([(1, 2, 5.0, ["x"])], "o_id long, o_cust long, price double, tags array<string>").createOrReplaceTempView("l_orders")
    spark.createDataFrame([(2, "n", "de")], "c_id long, c_name string, land string").createOrReplaceTempView("l_cust")
    spark.createDataFrame([("de",)], "land string").createOrReplaceTempView("l_lands")
    for name, sql in {
        "l_sales": "SELECT c.c_name AS who, sum(o.price * 2) AS total, count(*) AS n FROM l_orders o JOIN l_cust c ON o.o_cust = c.c_id GROUP BY c.c_name",
        "l_top": "SELECT who, total, row_number() OVER (ORDER BY total) AS place FROM (SELECT * FROM l_sales) s WHERE n > 1",
        "l_both": "SELECT who AS name, total AS x FROM l_top UNION ALL SELECT c_name, CAST(c_id AS DOUBLE) FROM l_cust",
        "l_tags": "SELECT o_id, tag FROM l_orders LATERAL VIEW explode(tags) t AS tag",
        "l_known": "SELECT c_id FROM l_cust WHERE land IN (SELECT land FROM l_lands)",
        "l_cte": "WITH a AS (SELECT o_cust AS k, max(price) AS p FROM l_orders GROUP BY o_cust) SELECT a.p AS best, (SELECT max(land) FROM l_lands) AS land FROM a",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS {sql}")


WANT = {
    "l_sales": {("l_cust", "c_name", "who"), ("l_orders", "price", "total")},
    "l_top": {("l_sales", "who", "who"), ("l_sales", "total", "total"), ("l_sales", "total", "place")},
    "l_both": {("l_top", "who", "name"), ("l_cust", "c_name", "name"), ("l_top", "total", "x"), ("l_cust", "c_id", "x")},
    "l_tags": {("l_orders", "o_id", "o_id"), ("l_orders", "tags", "tag")},
    "l_known": {("l_cust", "c_id", "c_id"), ("l_lands", None, None)},
    "l_cte": {("l_orders", "price", "best"), ("l_lands", "land", "land")},
}


def test_views(spark, views):
    got = lineage.view_links(spark, list(WANT)).collect()
    for view, want in WANT.items():
        assert {(r.from_table, r.from_column, r.to_column) for r in got if r.to_table == view} == want, view
    assert {(r.kind, r.via) for r in got if r.to_table == "l_top"} == {("feeds", "view l_top")}


def test_statements(spark, views, tmp_path):
    spark.sql(f"CREATE TABLE IF NOT EXISTS l_target (a STRING, b DOUBLE) USING parquet LOCATION '{tmp_path}/t'")
    try:
        got = lineage.statement_links(spark, ["INSERT INTO l_target SELECT who, total FROM l_sales", "SELECT 1", "CREATE TABLE l_made USING parquet AS SELECT place AS p FROM l_top"]).collect()
        assert {(r.from_table, r.from_column, r.to_table, r.to_column, r.kind, r.via) for r in got} == {
            ("l_sales", "who", "l_target", "a", "writes", "statement 1"), ("l_sales", "total", "l_target", "b", "writes", "statement 1"), ("l_top", "place", "l_made", "p", "writes", "statement 3")
        }
        assert spark.table("l_target").count() == 0 and not spark.catalog.tableExists("l_made")
    finally:
        spark.sql("DROP TABLE l_target")


def test_closure(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5), (3, None)]
    got = {(r.source, r.target): r.steps for r in lineage.closure(spark.createDataFrame(links, "source long, target long")).collect()}
    want = {}
    for s in {a for a, _ in links}:
        seen, edge, n = {s}, {s}, 0
        while edge:
            n += 1
            edge = {b for a, b in links if a in edge and b is not None} - seen
            seen |= edge
            want |= {(s, t): n for t in edge}
    assert got == want
    with pytest.raises(RuntimeError):
        lineage.closure(spark.createDataFrame([(i, i + 1) for i in range(9)], "source long, target long"), most=4)


def test_due_and_domains(spark):
    now = datetime.datetime(2024, 5, 20)
    keys = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4), ("d", 5)], "key string, place int")
    scanned = spark.createDataFrame([("b", now - datetime.timedelta(days=2)), ("c", now - datetime.timedelta(days=9))], "key string, at timestamp")
    assert [r.key for r in lineage.due(keys, scanned, now, budget=2).collect()] == ["a", "c"]
    domains = spark.createDataFrame([("Sales", ["o", "c"], 2), ("Sales › Orders", ["o"], 2), ("Money", ["o"], 3), ("All", ["o", "c"], 2)], "path string, tables array<string>, rank int")
    got = sorted(tuple(r) for r in lineage.domains_of(domains).collect())
    assert got == [("c", 1, "All"), ("c", 2, "Sales"), ("o", 1, "Money"), ("o", 2, "Sales › Orders"), ("o", 3, "All"), ("o", 4, "Sales")]
