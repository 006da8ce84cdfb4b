"""Each query with SQL gives DuckDB's rows on the smallest tables; each without runs."""

import decimal
import math
import os

import duckdb
import pytest

from tidemill.plans import registry
from tidemill.plans.catalog import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in ORACLES:
        assert df.columns and got
        return
    r = duck.execute(ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(names)
    want = rows(names, r.fetchall())
    assert len(got) == len(want), (len(got), len(want), got[:2], want[:2])
    assert got == want, next((a, b) for a, b in zip(got, want) if a != b)
