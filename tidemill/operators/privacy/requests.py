"""Protection of nested requests that fails closed.

Every string of a column, at any depth of structs, arrays and maps (their keys too), is a text of its own: all are found by
the schema, protected in one pass, so that a value has one pseudonym wherever it stands, and put back in their places. A
request one of whose texts a detector fails on does not pass: its columns are null, and the error's class says why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.privacy import detect
from tidemill.operators.privacy.protect import ROW, _protected, exploded, numbered
from tidemill.operators.stored import stored

LEAF = "array<struct<path:string,text:string>>"


def has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_text(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return has_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return has_text(kind.keyType) or has_text(kind.valueType)
    return isinstance(kind, (T.StringType, T.VarcharType, T.CharType))


def texts(c: Column, kind: T.DataType, path: Column) -> Column:
    """path and text of every string in a value."""
    none = F.array().cast(LEAF)
    if not has_text(kind):
        return none
    if isinstance(kind, T.StructType):
        parts = [texts(c.getField(f.name), f.dataType, F.concat(path, F.lit(f".{i}"))) for i, f in enumerate(kind)]
        return F.concat(none, *parts)
    if isinstance(kind, T.ArrayType):
        each = F.transform(c, lambda x, i: texts(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"))))
        return F.coalesce(F.flatten(each), none)
    if isinstance(kind, T.MapType):
        keys = texts(F.map_keys(c), T.ArrayType(kind.keyType), F.concat(path, F.lit("k")))
        return F.concat(keys, texts(F.map_values(c), T.ArrayType(kind.valueType), F.concat(path, F.lit("v"))))
    return F.when(c.isNull(), none).otherwise(F.array(F.struct(path.alias("path"), c.cast("string").alias("text"))))


def rebuilt(c: Column, kind: T.DataType, path: Column, new: Column) -> Column:
    """The value with the texts of a map by path in their places."""
    if not has_text(kind):
        return c
    if isinstance(kind, T.StructType):
        parts = [rebuilt(c.getField(f.name), f.dataType, F.concat(path, F.lit(f".{i}")), new).alias(f.name) for i, f in enumerate(kind)]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x, i: rebuilt(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string")), new))
    if isinstance(kind, T.MapType):
        keys = rebuilt(F.map_keys(c), T.ArrayType(kind.keyType), F.concat(path, F.lit("k")), new)
        return F.when(c.isNotNull(), F.map_from_arrays(keys, rebuilt(F.map_values(c), T.ArrayType(kind.valueType), F.concat(path, F.lit("v")), new)))
    return F.when(c.isNotNull(), F.element_at(new, path))


def protected_requests(df: DataFrame, secret: str, columns: list[str], error: str = "error", rules: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(df with all strings of some columns protected, and the class of the error of each row that could not be; the vault).

    Rows may be equal or have nulls anywhere; a null column, array or struct stays null. Two keys of a map that become one
    (both withheld) can't both stand: such a row fails too, with the class DuplicateKey.
    """
    rows = numbered(df)
    leaves = F.concat(*[texts(F.col(f"`{c}`"), rows.schema[c].dataType, F.lit(str(i))) for i, c in enumerate(columns)])
    flat = rows.select(F.col(ROW).alias("__owner"), F.explode(leaves).alias("t")).select("__owner", "t.path", "t.text")
    flat = numbered(flat)
    seen = stored(detect.detected(flat.select(ROW, "__owner", "text"), "text", errors="__error", rules=rules or detect.RULES), "request-found")
    failed = stored(seen.where("__error IS NOT NULL").groupBy("__owner").agg(F.min("__error").alias("__error")), "request-failed")
    sound = flat.join(failed.select("__owner"), "__owner", "left_anti")
    found = stored(exploded(seen.join(failed.select("__owner"), "__owner", "left_anti"), [ROW]), "request-spans")
    out, vault = _protected(sound, secret, "text", found=found)
    # texts of maps' keys that are one now
    keys = out.where(F.col("path").rlike(r"k\[\d+$")).groupBy("__owner", F.regexp_replace("path", r"\[\d+$", "").alias("p"), "text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    failed = failed.unionByName(keys.select("__owner", F.lit("DuplicateKey").alias("__error")).distinct())
    back = out.groupBy("__owner").agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("__new"))
    met = rows.join(back.withColumnRenamed("__owner", ROW), ROW, "left").join(failed.withColumnRenamed("__owner", ROW), ROW, "left")
    own = {c: F.when(F.col("__error").isNull(), rebuilt(F.col(f"`{c}`"), rows.schema[c].dataType, F.lit(str(i)), F.coalesce("__new", F.create_map().cast("map<string,string>")))) for i, c in enumerate(columns)}
    return met.select(*[own[c].alias(c) if c in own else F.col(f"`{c}`") for c in df.columns if c != error], F.col("__error").alias(error)), vault
