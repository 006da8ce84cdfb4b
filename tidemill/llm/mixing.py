"""Mixing sources to target weights, with DataFrame functions only.

The words of each source lie end to end, documents in a hashed order, and are cut into blocks of BLOCK words. Every
output shard draws the sources of its slots (a multinomial draw, by hashing the slot's number); the draws of a source
are numbered over the shards, and its n-th draw is the block at a pseudorandom permutation of n, a fresh permutation
for each pass over the source. Draws beyond a source's quota are left out, and what is missing goes to closing shards,
so each source gives its target exactly: the last block it gives is cut. Blocks meet slots by source and block number.

Nulls: a null text has no words; a null source is a source of its own, the last one; a null doc_id is kept. Repeated
rows are documents of their own. Documents without words, and empty tables, take nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import WORD_REGEX, stored, table

#: Fixed values of the contract.
WEIGHTS, MOST_PASSES = (5, 2, 1), 3
BLOCK, SHARD_SLOTS, BUCKETS, ROUNDS, SEED = 128, 4096, 1024, 20, 20240101
#: So many cells at most, besides one for each source, tell which source a draw falls to.
CELLS = 1 << 14
#: More sources than that are joined by shuffling instead of broadcast.
BROADCAST_SOURCES = 20_000


def permuted(x: Column, n: Column, *key: Column, back: bool = False) -> Column:
    """x in a pseudorandom permutation of 0..n-1 (swap or not, whose rounds undo themselves); back: its inverse."""
    steps = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)

    def step(acc: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), *key, r), n) - acc, n)
        return F.when(F.pmod(F.xxhash64(F.lit(SEED + 1), *key, r, F.greatest(acc, other)), F.lit(2)) == 1, other).otherwise(acc)

    return F.aggregate(F.array(*[F.lit(r) for r in steps]), x, step)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, and text_hash with copy to find a row again (copy numbers rows alike)."""
    rows = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD_REGEX)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("text_hash"),
    )
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("source", "size")))


def source_targets(sizes: DataFrame) -> DataFrame:
    """rank, source, source_size, weight, target of each source. One row a source: the only table sorted in one task."""
    total = F.sum("source_size").over(Window.partitionBy())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("most", MOST_PASSES * F.col("source_size")).withColumn("total", total)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    s = s.withColumn("place", F.row_number().over(by_ratio))
    s = s.withColumn("level", (F.col("total") - F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) + F.col("most")) / (F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))))
    s = s.withColumn("full", F.col("most") / F.col("weight") <= F.col("level"))
    share = F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(Window.partitionBy())["level"]
    s = s.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(share * F.col("weight")))
    return s.select("rank", "source", "source_size", "weight", "target")


def quotas(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds blocks, draws (so many it gives) and cut (words of the last block it gives)."""
    s = sources.withColumn("blocks", F.ceil(F.col("source_size") / block)).where("source_size > 0")
    s = s.withColumn("words", F.floor(F.col("target") + 1e-6).cast("long"))
    s = s.withColumn("passes", F.expr("words div source_size")).withColumn("rest", F.col("words") % F.col("source_size"))
    short = block * F.col("blocks") - F.col("source_size")  # words that the last block lacks
    s = s.withColumn("short", short).withColumn("short_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.col("rank"), F.col("passes"), back=True))
    got = lambda k: k * block - F.when(F.col("short_at") < k, F.col("short")).otherwise(0)
    s = s.withColumn("more", F.ceil(F.col("rest") / block))
    s = s.withColumn("more", F.col("more") + (got(F.col("more")) < F.col("rest")).cast("long"))
    s = s.withColumn("draws", F.col("passes") * F.col("blocks") + F.col("more"))
    s = s.withColumn("cut", F.when(F.col("more") == 0, block).otherwise(F.col("rest") - got(F.col("more") - 1)))
    return s.drop("words", "rest", "short", "short_at", "more", "passes")


def drawn_slots(quota: DataFrame, n_sources: int, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, rank, draw, block, words (of the block) of each slot. quota: a stored table."""
    spark = quota.sparkSession
    n = quota.agg(F.sum("draws")).first()[0] or 0
    width = max(1, n // CELLS)
    ends = quota.withColumn("hi", F.sum("draws").over(Window.orderBy("rank"))).withColumn("lo", F.col("hi") - F.col("draws")).where("draws > 0")
    cells = ends.select("rank", "lo", "hi", F.explode(F.expr(f"sequence(lo div {width}L, (hi - 1) div {width}L)")).alias("cell"))
    small = n_sources <= BROADCAST_SOURCES
    draws = spark.range(n).select(F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit(SEED + 2), "id"), F.lit(max(n, 1))).alias("v"))
    draws = draws.withColumn("cell", F.expr(f"v div {width}L"))
    counts = draws.join(F.broadcast(cells) if small else cells, "cell").where("v >= lo AND v < hi").groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("c"))
    shards = Window.partitionBy("rank").orderBy("shard")
    counts = counts.withColumn("first", F.sum("c").over(shards.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    known = F.broadcast(quota) if small else quota
    within = counts.join(known, "rank").where("first < draws").select("rank", "shard", F.explode(F.expr("sequence(first, least(first + c, draws) - 1)")).alias("draw"))
    drawn = counts.groupBy("rank").agg(F.sum("c").alias("drawn"))
    closing = quota.join(drawn, "rank", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).where("drawn < draws")
    closing = closing.select("rank", F.lit((n + shard_slots - 1) // shard_slots).alias("shard"), F.explode(F.expr("sequence(drawn, draws - 1)")).alias("draw"))
    slots = within.unionByName(closing).join(known.select("rank", "blocks", "draws", "cut", "source_size"), "rank")
    at = permuted(F.col("draw") % F.col("blocks"), F.col("blocks"), F.col("rank"), F.expr("draw div blocks"))
    slots = slots.withColumn("block", at)
    words = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    return slots.select("shard", "rank", "draw", F.expr("draw div blocks").alias("pass"), "block", F.when(F.col("draw") == F.col("draws") - 1, F.least(words, F.col("cut"))).otherwise(words).alias("words"))


def placed(sizes: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """sizes with rank and start, its first word's place in its source. Sums run within hashed buckets, then over them."""
    keys = sources.select("rank", "source", "source_size", "target")
    s = sizes.join(F.broadcast(keys) if n_sources <= BROADCAST_SOURCES else keys, sizes["source"].eqNullSafe(keys["source"])).drop(keys["source"])
    s = s.withColumn("order", F.xxhash64(F.lit(SEED + 3), "doc_id", "text_hash")).withColumn("bucket", F.pmod("order", F.lit(BUCKETS)))
    own = Window.partitionBy("rank", "bucket").orderBy("order", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, 0)
    total = s.groupBy("rank", "bucket").agg(F.sum("size").alias("of_bucket"))
    before = total.withColumn("base", F.sum("of_bucket").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("of_bucket")).drop("of_bucket")
    s = s.withColumn("start", F.sum("size").over(own) - F.col("size"))
    before = F.broadcast(before) if n_sources * BUCKETS <= BROADCAST_SOURCES * 5 else before
    return s.join(before, ["rank", "bucket"]).withColumn("start", F.col("start") + F.col("base")).drop("order", "bucket", "base")


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). documents: placed(). pieces: shard, draw, pass, and for a document in that slot's block its
    row (doc_id, text_hash, copy, rank, start, size), from (its first word taken) and taken (words)."""
    sizes = stored(measured(docs), "mix-sizes")
    sources = stored(source_targets(sizes), "mix-sources")
    n_sources = sources.count()
    slots = drawn_slots(stored(quotas(sources, block), "mix-quotas"), n_sources, block, shard_slots)
    rows = placed(sizes, sources, n_sources)
    parts = rows.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}L, (start + size - 1) div {block}L)")))
    parts = parts.withColumn("at", F.greatest(F.col("start") - F.col("block") * block, F.lit(0))).withColumn("end", F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block)))
    met = slots.join(parts, ["rank", "block"]).where("words > at")
    met = met.withColumn("taken", F.least("end", "words") - F.col("at")).withColumn("from", F.col("block") * block + F.col("at") - F.col("start"))
    return rows, met.select("shard", "draw", "pass", "doc_id", "text_hash", "copy", "rank", "start", "size", "source_size", "target", "from", "taken")


def mixed_texts(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as rows like documents': a row for each pass in which a document is taken, with the words taken.

    A document taken whole keeps its text; else the words taken are joined by spaces. n_chars follows the text.
    """
    columns = docs.columns
    _, pieces = mix(docs, block, shard_slots)
    key = ["doc_id", "text_hash", "copy"]
    spans = pieces.groupBy(*key, "pass", "size").agg(F.sum("taken").alias("taken"), F.sort_array(F.collect_list(F.struct("from", "taken"))).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("copy").alias("__copy"), F.col("size").alias("__size"), F.col("taken").alias("__taken"), F.col("spans").alias("__spans"))
    whole = docs.withColumn("__h", F.xxhash64("text")).withColumn("__c", F.row_number().over(Window.partitionBy("doc_id", "__h").orderBy("source")))
    both = whole.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")) & (F.col("__c") == F.col("__copy")))
    words = F.regexp_extract_all("text", F.lit(WORD_REGEX), F.lit(0))
    some = F.array_join(F.transform("__spans", lambda s: F.array_join(F.slice(F.col("__words"), s["from"].cast("int") + 1, s["taken"].cast("int")), " ")), " ")
    both = both.withColumn("__words", F.when(F.col("__taken") < F.col("__size"), words))
    both = both.withColumn("text", F.when(F.col("__taken") == F.col("__size"), F.col("text")).otherwise(some))
    if "n_chars" in columns:
        both = both.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return both.select(*[F.col(f"`{c}`") for c in columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: words taken of each document."""
    rows, pieces = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    key = ["doc_id", "size", "source_size", "target", "rank", "start", "copy", "text_hash"]
    none = rows.select(*key, F.lit(0).cast("long").alias("taken"))
    taken = pieces.select(*key, "taken").unionByName(none.where("size > 0")).groupBy(*key).agg(F.sum("taken").alias("taken"))
    return taken.unionByName(none.where("size = 0")).select("doc_id", "size", "source_size", "target", "taken")
