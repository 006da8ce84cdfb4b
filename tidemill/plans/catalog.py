"""What tables and columns there are, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The test tables' foreign keys: fixed values.
EDGES = (
    "nation.n_regionkey=region.r_regionkey customer.c_nationkey=nation.n_nationkey supplier.s_nationkey=nation.n_nationkey orders.o_custkey=customer.c_custkey "
    "lineitem.l_orderkey=orders.o_orderkey lineitem.l_partkey=part.p_partkey lineitem.l_suppkey=supplier.s_suppkey labels.doc_id=documents.doc_id"
).split()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def edges(spark: SparkSession, of: list[str] = EDGES) -> DataFrame:
    rows = [(*a.split("."), *b.split(".")) for a, b in (e.split("=") for e in of)]
    return spark.createDataFrame(rows, "from_table string, from_column string, to_table string, to_column string")


def columns(tables: dict[str, DataFrame]) -> DataFrame:
    """table, ordinal, column, type of every column: schemas only, no data is read."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, i, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "table string, ordinal int, column string, type string, nullable boolean")


def create_table(name: str, df: DataFrame, keys: list[str] = ()) -> str:
    quote = lambda n: '"' + n.replace('"', '""') + '"'
    lines = [f"  {quote(f.name)} {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in df.schema]
    lines += [f"  PRIMARY KEY ({', '.join(map(quote, keys))})"] if keys else []
    return f"CREATE TABLE {quote(name)} (\n" + ",\n".join(lines) + "\n)"


def lines(cols: DataFrame, fk: DataFrame) -> DataFrame:
    """table, line: name(column type fk->table, ...) in the order of the columns."""
    refs = fk.select(F.col("from_table").alias("table"), F.col("from_column").alias("column"), F.concat(F.lit(" fk->"), "to_table").alias("ref"))
    rows = cols.join(refs, ["table", "column"], "left").select("table", F.struct("ordinal", F.concat("column", F.lit(" "), "type", F.coalesce("ref", F.lit(""))).alias("text")).alias("c"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["text"]), ", ")
    return rows.groupBy("table").agg(F.concat(F.col("table"), F.lit("("), body, F.lit(")")).alias("line"))


def referenced_by(fk: DataFrame) -> DataFrame:
    return fk.groupBy(F.col("to_table").alias("table")).agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(".", "from_table", "from_column"))), ", ").alias("referenced_by"))
