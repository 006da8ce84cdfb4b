"""Staged edits and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import csv_field, sql_literal


class EditError(ValueError):
    pass


def applied(df: DataFrame, changes: DataFrame, keys: list[str], checked: bool = True) -> DataFrame:
    """df after changes (op: insert, update or delete; the keys; new values, null where they stay; and if wanted `nulls`, an
    array of the columns that an update sets to null). Several updates of one row count together. All or nothing: each
    must hit exactly one row, and no two may set one column, else EditError tells how many. The result is a new table to
    be written."""
    others = [c for c in df.columns if c not in keys]
    on = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    touch = changes.where("op <> 'insert'")
    if checked:
        hits = touch.select(*keys).distinct().join(df.select(*keys, F.lit(1).alias("hit")), on=[*keys], how="left").groupBy(*keys).agg(F.count("hit").alias("n"))
        wrong = hits.where("n <> 1").count()
        if wrong:
            raise EditError(f"{wrong} of the changes don't hit exactly one row")
    gone = changes.where("op = 'delete'")
    left = df.join(gone, on(df, gone), "left_anti")
    nulls = F.col("nulls") if "nulls" in changes.columns else F.array().cast("array<string>")
    sets = lambda c: F.col(c).isNotNull() | F.array_contains(nulls, c)
    new = changes.where("op = 'update'").groupBy(*[F.col(k).alias(f"k_{k}") for k in keys]).agg(
        *[F.max(c).alias(f"n_{c}") for c in others],
        *[F.max(F.coalesce(F.array_contains(nulls, c), F.lit(False))).alias(f"z_{c}") for c in others],
        F.greatest(*[F.count_if(sets(c)) for c in others], F.lit(0)).alias("twice"),
    )
    if checked and new.where("twice > 1").count():
        raise EditError("two changes set the same column of one row")
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys])
    updated = left.join(new, cond, "left").select(*keys, *[F.when(F.coalesce(f"z_{c}", F.lit(False)), F.lit(None)).otherwise(F.coalesce(f"n_{c}", c)).alias(c) for c in others])
    return updated.select(*df.columns).unionByName(changes.where("op = 'insert'").select(*df.columns))


def csv_lines(df: DataFrame) -> DataFrame:
    """line: fields quoted where they must be; the header is `csv_header`. Written with write.text and lineSep \\r\\n, newlines in fields stay."""
    kinds = dict(df.dtypes)
    return df.select(F.concat_ws(",", *[csv_field(F.col(f"`{c}`"), kinds[c]) for c in df.columns]).alias("value"))


def csv_header(df: DataFrame) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') else c for c in df.columns)


def write_csv(df: DataFrame, path: str) -> None:
    head = df.sparkSession.createDataFrame([(csv_header(df),)], "value string")
    csv_lines(df).write.option("lineSep", "\r\n").text(f"{path}/rows")
    head.coalesce(1).write.option("lineSep", "\r\n").text(f"{path}/header")


def json_lines(df: DataFrame) -> DataFrame:
    """One object a row; NaN and infinities are null, whole numbers beyond 2^53 are texts, bytes are hex."""
    out = []
    for c, kind in df.dtypes:
        x = F.col(f"`{c}`")
        if kind in ("double", "float"):
            x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
        elif kind == "binary":
            x = F.lower(F.hex(x))
        out.append(x.alias(c))
    return df.select(F.to_json(F.struct(*out), {"ignoreNullFields": "false"}).alias("value"))


def insert_statements(df: DataFrame, table: str, schema: str | None = None) -> DataFrame:
    quote = lambda n: '"' + n.replace('"', '""') + '"'
    name = ".".join(quote(p) for p in ([schema] if schema else []) + [table])
    head = f"INSERT INTO {name} ({', '.join(quote(c) for c in df.columns)}) VALUES ("
    return df.select(F.concat(F.lit(head), F.concat_ws(", ", *[sql_literal(F.col(f"`{c}`"), k) for c, k in df.dtypes]), F.lit(");")).alias("value"))
