"""Small helpers that several training-data operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.stored import dropped, mark, scratch, shared_folder, stored

__all__ = ["SPACE_CLASS", "WORD_REGEX", "clash_free", "dropped", "filter_bits", "mark", "marked", "marks", "scratch", "shared_folder", "stored", "table"]

#: What separates words (the ASCII white space), and what a word is.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_REGEX = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clash_free(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns of df; those it lacks are null strings. Extra columns can't clash with own ones."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


#: Bits that tell which rows a stage needs, so that others aren't shuffled: their size is bounded whatever the table's.
MARK_BITS = 1 << 25


def marks(rows: DataFrame, name: str) -> DataFrame:
    """bucket, bits: the hashed ids of rows (doc_id). At most MARK_BITS / 8 bytes."""
    x = F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS)) + 1
    bits = rows.select(x.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    return stored(bits, name)


def filter_bits(rows: DataFrame, name: str = "item") -> np.ndarray:
    """Bits by the last bits of a column of whole numbers, MARK_BITS / 8 bytes whatever the table's size: what may be among them."""
    x = F.pmod(F.col(name), F.lit(MARK_BITS)) + 1
    bits = rows.select(x.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = np.zeros((MARK_BITS // 32768, 4096), np.uint8)
    for r in bits.collect():
        out[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def marked(docs: DataFrame, bits: DataFrame) -> DataFrame:
    """docs with `marked`: false only if the row's doc_id is not among the marked ones."""
    x = F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS)) + 1
    own = docs.withColumn("__bucket", F.bitmap_bucket_number(x)).withColumn("__at", F.bitmap_bit_position(x))
    own = own.join(F.broadcast(bits.withColumnRenamed("bucket", "__bucket")), "__bucket", "left")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("__at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    bit = F.expr("shiftright(__byte, cast(__at % 8 AS int)) & 1")
    return own.withColumn("__byte", byte).withColumn("marked", F.coalesce(bit == 1, F.lit(False))).drop("bits", "__byte", "__bucket", "__at")
