"""Pages, counts, samples and search over tables."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE, MOST = 200, 100_000
SAMPLE_VALUES, SAMPLE_CHARS, SAMPLE_COLUMNS = 20, 40, 24


def visible(df: DataFrame) -> DataFrame:
    """Columns that are not hidden: a field's metadata may say {"hidden": 1}."""
    return df.select(*[F.col(f"`{f.name}`") for f in df.schema if f.metadata.get("hidden") != 1])


def filtered(df: DataFrame, where: str | None) -> DataFrame:
    """A predicate as SQL text. Empty text keeps all; the text is one expression, or parsing fails."""
    return df.where(F.expr(where)) if where and where.strip() else df


def ordered(df: DataFrame, by: str | None, descending: bool = False, ties: list[str] | None = None) -> DataFrame:
    """Nulls are the least values. ties: columns that make the order of a page the same each time."""
    if by is None:
        return df
    if by not in df.columns:
        raise ValueError(f"Cannot sort by unknown column {by}")
    first = F.desc_nulls_last(f"`{by}`") if descending else F.asc_nulls_first(f"`{by}`")
    return df.orderBy(first, *[F.asc_nulls_first(f"`{t}`") for t in ties or [] if t != by])


def page(df: DataFrame, where: str | None = None, by: str | None = None, descending: bool = False, offset: int = 0, limit: int = PAGE, ties: list[str] | None = None) -> DataFrame:
    """One page. limit is held within 1 and 100,000, offset is not below 0."""
    rows = ordered(filtered(visible(df), where), by, descending, ties)
    return rows.offset(max(0, offset)).limit(max(1, min(MOST, limit)))


def counted(df: DataFrame, where: str | None = None) -> DataFrame:
    return filtered(df, where).agg(F.count(F.lit(1)).alias("n"))


def truncated(df: DataFrame, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(at most `most` rows, one row telling whether there are more): only most + 1 rows are read."""
    most = most or 1000
    return df.limit(most), df.limit(most + 1).agg((F.count(F.lit(1)) > most).alias("truncated"), F.least(F.count(F.lit(1)), F.lit(most)).alias("rows"))


def distinct_sample(df: DataFrame, column: str, most: int = SAMPLE_VALUES) -> DataFrame:
    """Up to `most` distinct values as text, in order; none if there are more, as then they tell nothing."""
    values = df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct().orderBy("value").limit(most + 1)
    n = values.agg(F.count(F.lit(1)).alias("n"))
    return values.join(F.broadcast(n), F.col("n") <= most).select("value")


def sample_columns(df: DataFrame, keys: list[str] = ()) -> list[str]:
    """Columns worth sampling: texts that are no key."""
    return [f.name for f in df.schema if f.dataType.simpleString().startswith(("string", "varchar", "char")) and f.name not in keys][:SAMPLE_COLUMNS]


def sampled(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """column, values: of each eligible column with few and short values. One pass; sets stop growing past the limit by two aggregates."""
    names = sample_columns(df, keys)
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("value")) for n in names])).alias("x")).select("x.*").where("value IS NOT NULL")
    distinct = tall.distinct()
    few = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("value")).alias("longest")).where((F.col("n") <= SAMPLE_VALUES) & (F.col("longest") <= SAMPLE_CHARS))
    return distinct.join(F.broadcast(few), "column").groupBy("column").agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("values"))


def inferred_types(df: DataFrame, column: str) -> DataFrame:
    """Storage class of texts by their values: INTEGER, REAL (also with integers among them), TEXT, or none if mixed or all null."""
    v = F.col(column)
    kind = F.when(v.isNull(), None).when(v.rlike(r"^[+-]?\d{1,18}$"), "INTEGER").when(v.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "REAL").otherwise("TEXT")
    kinds = df.agg(F.sort_array(F.collect_set(kind)).alias("k"))
    one = F.when(F.size("k") == 1, F.col("k")[0]).when(F.col("k") == F.array(F.lit("INTEGER"), F.lit("REAL")), "REAL")
    return kinds.select(F.lit(column).alias("column"), one.alias("storage"))


# --- keyset pages ---


def cursor(values: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, default=str).encode()).decode().rstrip("=")


def read_cursor(text: str) -> dict:
    return json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))


def beyond(keys: list[str], after: dict) -> Column:
    """(k1, k2, ...) > the cursor's values, spelt out, so that it is pushed down and types may differ."""
    out = F.lit(False)
    for i in range(len(keys) - 1, -1, -1):
        k, v = F.col(keys[i]), F.lit(after[keys[i]])
        out = (k > v) | ((k == v) & out)
    return out


def keyset_page(df: DataFrame, keys: list[str], limit: int = 2000, after: str | dict | None = None) -> DataFrame:
    """The next rows in the order of keys; take limit + 1 to see whether more follow."""
    if after is not None:
        df = df.where(beyond(keys, read_cursor(after) if isinstance(after, str) else after))
    return df.orderBy(*keys).limit(max(1, min(20_000, limit)))


def searched(df: DataFrame, column: str, query: str, limit: int = 100) -> DataFrame:
    """Rows whose column contains the query in any case; those that begin with it come first."""
    q, name = F.lower(F.lit(query.strip())), F.lower(F.col(column))
    return df.where(name.contains(q)).orderBy(name.startswith(q).desc(), name, F.col(column)).limit(limit)


def of_refs(df: DataFrame, refs: DataFrame, on: list[str]) -> DataFrame:
    """Rows that a table of references names: one join instead of batches."""
    return df.join(refs.select(*on).distinct(), on, "left_semi")


def touching(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Foreign-key edges (from_table, to_table, ...) with either end among tables (name)."""
    t = tables.select("name").distinct()
    left = edges.join(t, edges["from_table"] == t["name"], "left_semi")
    right = edges.join(t, edges["to_table"] == t["name"], "left_semi")
    return left.unionByName(right).distinct()
