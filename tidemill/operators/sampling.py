"""Samples that are the same whenever they are drawn: what is in one follows from a hash of the row's key, not from
tasks or their order, so partitions, retries and reruns make no difference, and tables that share a key share its sample.

A weighted sample gives each row the priority weight / u, where u is its hash in (0, 1], and takes the highest: larger
weights are likelier, and max(weight, threshold) of the sampled rows estimates any sum of weights without bias. Only the top of
each task goes on. A sample by stratum takes in each the least hashes, first those of each task; a stratum with a third of
all rows costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITS = 13


def share(key: Column, seed: str) -> Column:
    """A number in (0, 1] of a key: the first hex digits of a hash of the seed and the key. A null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") + 1) / F.lit(float(16**DIGITS))


def bernoulli(df: DataFrame, key: str, fraction: float, seed: str) -> DataFrame:
    """The rows whose key is among a fraction of all keys. A larger fraction has all rows of a smaller one. No shuffle."""
    return df.where(share(F.col(key), seed) <= fraction)


def weighted(df: DataFrame, key: str, weight: str, n: int, seed: str) -> DataFrame:
    """n rows by priority (ties: by key), with `estimate`, which adds up to about the sum of all weights in any group of rows.
    Rows without a positive weight are in no sample."""
    priority = F.col(weight).cast("double") / share(F.col(key), seed)
    some = df.where(F.col(weight) > 0).withColumn("__priority", priority)
    top = some.orderBy(F.desc("__priority"), key).limit(n + 1)
    # the priority of the row that just missed; of a table with no more rows than wanted none did
    threshold = top.agg(F.when(F.count(F.lit(1)) > n, F.min("__priority")).otherwise(0.0).alias("__threshold"))
    rows = top.orderBy(F.desc("__priority"), key).limit(n).crossJoin(F.broadcast(threshold))
    return rows.withColumn("estimate", F.greatest(F.col(weight).cast("double"), F.col("__threshold"))).drop("__priority", "__threshold")


def stratified(df: DataFrame, key: str, stratum: str, n: int, seed: str) -> DataFrame:
    """Up to n rows of each stratum, null being one: those with the least hashes (ties: by key)."""
    order = Window.partitionBy(stratum).orderBy("__share", key)
    rows = df.withColumn("__share", share(F.col(key), seed)).withColumn("__place", F.row_number().over(order))
    return rows.where(F.col("__place") <= n).drop("__share", "__place")
