"""Queries with SQL give DuckDB's rows."""

import duckdb
import pytest

from tidemill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("benchmark", "documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    r = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    got = [tuple(x[n] for n in names) for x in df.collect()]
    assert sorted(got, key=repr) == sorted(r.fetchall(), key=repr)
