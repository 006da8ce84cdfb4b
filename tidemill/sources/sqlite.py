"""A SQLite file as a Spark data source. Read-only; split by rowid ranges; columns, and simple filters if wanted, go into its SQL.

spark.dataSource.register(SqliteSource); spark.read.format("sqlite").option("path", file).option("table", name).load()
Filters are pushed with the option pushdown, which needs spark.sql.python.filterPushdown.enabled. The file must be in a
folder that all executors have.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no SQLite file at {path}")
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=5)
    con.text_factory = lambda b: b.decode(errors="replace")
    return con


def spark_type(declared: str) -> T.DataType:
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")) or d == "":
        return T.StringType()
    if "BLOB" in d:
        return T.BinaryType()
    return T.DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else T.StringType()


class Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        with opened(self.options["path"]) as con:
            rows = con.execute(f"PRAGMA table_xinfo({quoted(self.options['table'])})").fetchall()
        if not rows:
            raise ValueError(f"no table {self.options['table']}")
        return T.StructType([T.StructField(r[1], spark_type(r[2] or ""), not r[3]) for r in rows if r[6] != 1])

    def reader(self, schema: T.StructType) -> SqliteReader:
        pushes = str(self.options.get("pushdown", "false")).lower() == "true"
        return (PushingReader if pushes else SqliteReader)(dict(self.options), schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema, self.where, self.values = options, schema, [], []

    def partitions(self) -> list[Range]:
        parts = int(self.options.get("partitions", 4))
        with opened(self.options["path"]) as con:
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.options['table'])}").fetchone()
            except sqlite3.OperationalError:  # a view, or a table without rowid
                return [Range(None, None)]
        if not isinstance(low, int) or not isinstance(high, int) or high == low:
            return [Range(None, None)]
        step = -(-(high - low + 1) // parts)
        return [Range(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        where, values = list(self.where), list(self.values)
        if partition.low is not None:
            where.append("rowid BETWEEN ? AND ?")
            values += [partition.low, partition.high]
        names = ", ".join(quoted(f.name) for f in self.schema)
        sql = f"SELECT {names} FROM {quoted(self.options['table'])}" + (" WHERE " + " AND ".join(where) if where else "")
        casts = [self._cast(f.dataType) for f in self.schema]
        with opened(self.options["path"]) as con:
            for row in con.execute(sql, values):
                yield tuple(None if v is None else c(v) for c, v in zip(casts, row))

    @staticmethod
    def _cast(kind: T.DataType):
        if isinstance(kind, T.LongType):
            return lambda v: v if isinstance(v, int) else None
        if isinstance(kind, T.DoubleType):
            return lambda v: float(v) if isinstance(v, (int, float)) else None
        if isinstance(kind, T.BinaryType):
            return lambda v: v if isinstance(v, bytes) else str(v).encode()
        return lambda v: v if isinstance(v, str) else v.hex() if isinstance(v, bytes) else str(v)


class PushingReader(SqliteReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in signs and isinstance(f.value, (int, str)) and len(f.attribute) == 1:
                self.where.append(f"{quoted(f.attribute[0])} {signs[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1:
                self.where.append(f"{quoted(f.attribute[0])} IS NOT NULL")
            else:
                yield f
