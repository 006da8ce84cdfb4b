"""Named queries over the test tables, each with its DuckDB text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.plans import delegated, owned


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned.QUERIES["g11_email"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q[0] for name, q in owned.QUERIES.items()} | {name: delegated.query(name) for name in delegated.SQL}


def oracle_sql() -> dict[str, str]:
    return {name: q[1] for name, q in owned.QUERIES.items() if q[1]} | {name: sql[-1] for name, sql in delegated.SQL.items()}
