"""What a SQLite file says of its tables: small metadata, read on the driver and given as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemill.sources.sqlite import opened, quoted

ROWID_NAMES = ("rowid", "_rowid_", "oid")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """name, kind, of_table, definition of tables, views, indexes and triggers."""
    with opened(path) as con:
        rows = con.execute("SELECT name, type, tbl_name, sql FROM sqlite_master WHERE name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY type, name").fetchall()
    return spark.createDataFrame(rows, "name string, kind string, of_table string, definition string")


def columns(spark: SparkSession, path: str, table: str) -> DataFrame:
    """place, name, declared, not_null, default, key (its place in the primary key, 0 if none) and generated."""
    with opened(path) as con:
        rows = con.execute(f"PRAGMA table_xinfo({quoted(table)})").fetchall()
    if not rows:
        raise ValueError(f"no table {table}")
    made = [(r[0], r[1], r[2], bool(r[3]), r[4], r[5], r[6] in (2, 3)) for r in rows if r[6] != 1]
    return spark.createDataFrame(made, "place int, name string, declared string, not_null boolean, default string, key int, generated boolean")


def metadata(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One row: kind, definition, without_rowid, rowid_name (by which rows can be told) and primary_key."""
    with opened(path) as con:
        found = con.execute("SELECT type, sql FROM sqlite_master WHERE name = ? AND type IN ('table', 'view')", (table,)).fetchone()
        if found is None:
            raise ValueError(f"no table {table}")
        cols = con.execute(f"PRAGMA table_xinfo({quoted(table)})").fetchall()
    kind, sql = found
    bare = kind == "table" and bool(re.search(r"\bWITHOUT\s+ROWID\b", sql or "", re.I))
    taken = {c[1].lower() for c in cols}
    rowid = next((n for n in ROWID_NAMES if n not in taken), None) if kind == "table" and not bare else None
    key = [c[1] for c in sorted((c for c in cols if c[5]), key=lambda c: c[5])]
    return spark.createDataFrame([(kind, sql, bare, rowid, key)], "kind string, definition string, without_rowid boolean, rowid_name string, primary_key array<string>")


def indexes(spark: SparkSession, path: str, table: str) -> DataFrame:
    """name, distinct, origin (c: stated, u: of a unique constraint, pk: of the primary key), partial, columns, definition."""
    with opened(path) as con:
        listed = con.execute(f"PRAGMA index_list({quoted(table)})").fetchall()
        texts = dict(con.execute("SELECT name, sql FROM sqlite_master WHERE type = 'index'"))
        rows = [(r[1], bool(r[2]), r[3], bool(r[4]), [c[2] for c in con.execute(f"PRAGMA index_info({quoted(r[1])})")], texts.get(r[1])) for r in listed]
    return spark.createDataFrame(rows, "name string, distinct boolean, origin string, partial boolean, columns array<string>, definition string")


def foreign_keys(spark: SparkSession, path: str, table: str) -> DataFrame:
    """id, seq, from_column, to_table, to_column, on_update, on_delete."""
    with opened(path) as con:
        rows = [(r[0], r[1], r[3], r[2], r[4], r[5], r[6]) for r in con.execute(f"PRAGMA foreign_key_list({quoted(table)})")]
    return spark.createDataFrame(rows, "id int, seq int, from_column string, to_table string, to_column string, on_update string, on_delete string")


def triggers(spark: SparkSession, path: str, table: str) -> DataFrame:
    """name, definition."""
    return objects(spark, path).where("kind = 'trigger'").where(f"of_table = '{table.replace(chr(39), chr(39) * 2)}'").select("name", "definition")
