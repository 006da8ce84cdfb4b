"""Statistics of query logs, and what is kept of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HALF_LIFE_DAYS, ANSWER_HOURS, HISTORY, HISTORY_DAYS = 30, 2, 30, 30
#: How many of each kind are kept, and how far each source is trusted.
RETAINED = {"facts": 400, "domains": 150, "runbook": 150, "queries": 400, "links": 1500, "values": 1500}
TRUST = [("user", 3, 0.95, 0.99), ("confirmed", 2, 0.8, 0.95), ("model", 1, 0.55, 0.75), ("scan", 0, 0.4, 0.6)]


def by_shape(runs: DataFrame) -> DataFrame:
    """Runs (shape, sql, ok, ts, by_user): count, errors, the latest good SQL, first and last time, and whether a user ever ran it."""
    return runs.groupBy("shape").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(~F.col("ok")).alias("errors"),
        F.max_by(F.when(F.col("ok"), F.col("sql")), F.when(F.col("ok"), F.struct("ts", "sql"))).alias("latest_sql"),
        F.min("ts").alias("first_at"),
        F.max("ts").alias("last_at"),
        F.bool_or("by_user").alias("by_user"),
    )


def links(pairs: DataFrame) -> DataFrame:
    """Counts of (kind, a, b); joins have no direction."""
    join = F.col("kind") == "join"
    return pairs.select("kind", F.when(join, F.least("a", "b")).otherwise(F.col("a")).alias("a"), F.when(join, F.greatest("a", "b")).otherwise(F.col("b")).alias("b")).groupBy("kind", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def seen_values(rows: DataFrame) -> DataFrame:
    """Values of good runs (column, value, ts, ok), counted in any case; the latest spelling is kept."""
    return rows.where("ok").groupBy("column", F.lower("value").alias("folded")).agg(F.count(F.lit(1)).alias("n"), F.max_by("value", F.struct("ts", "value")).alias("value"))


def weight(count: Column, last: Column, now: Column) -> Column:
    """log2(1 + count), halved every 30 days; ages below 0 are 0."""
    age = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(last), F.lit(0))
    return F.log2(1 + count) * F.pow(F.lit(0.5), age / (HALF_LIFE_DAYS * 86400))


def retained(rows: DataFrame, score: Column, key: str, most: int) -> DataFrame:
    """The best by score, ties by key: a top-k, so no task sorts them all."""
    return rows.withColumn("score", score).orderBy(F.desc("score"), key).limit(most)


def reinforced(facts: DataFrame, uses: DataFrame, trust: DataFrame, amount: float = 0.02) -> DataFrame:
    """Facts (name, source, confidence, uses) with their uses (name, n) added, confidence up to the source's ceiling."""
    n = F.coalesce("n", F.lit(0))
    rows = facts.join(uses, "name", "left").join(F.broadcast(trust), "source")
    return rows.select("name", "source", F.least("ceiling", F.col("confidence") + amount * n).alias("confidence"), (F.col("uses") + n).alias("uses"))


def recalled_terms(terms: DataFrame, question: Column, words: Column, most: int = 10) -> DataFrame:
    """Terms (name, tokens, confidence) by the question: the phrase 10, all words 6, some 4 * share; times 0.5 + confidence; 3 at least."""
    hit = F.size(F.array_intersect(F.array_distinct("tokens"), words))
    n = F.greatest(F.size(F.array_distinct("tokens")), F.lit(1))
    base = F.when(F.lower(question).contains(F.lower("name")), 10.0).when(hit == n, 6.0).otherwise(4.0 * hit / n)
    return terms.withColumn("score", base * (0.5 + F.col("confidence"))).where("score >= 3").orderBy(F.desc("score"), "name").limit(most)


def overview(tables: DataFrame, shown: DataFrame, most: int = 12) -> DataFrame:
    """Distinct tables of each top domain (domain, table) that is not shown yet."""
    top = F.element_at(F.split("domain", "/"), 1)
    counts = tables.groupBy(top.alias("domain")).agg(F.countDistinct("table").alias("n_tables"))
    return counts.join(shown, "domain", "left_anti").orderBy(F.desc("n_tables"), "domain").limit(most)


def seeds(hits: DataFrame, most: int = 10) -> DataFrame:
    return hits.groupBy("table").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "table").limit(most)


def matched_answers(answers: DataFrame, runs: DataFrame, hours: int = ANSWER_HOURS) -> DataFrame:
    """Each answer (key, answer_id, at) with its first run (key, run_id, ran) within the hours; a run takes the latest answer before it.

    The equi-join is by key and hour, an answer standing in each hour it lasts, so a frequent key spreads over time.
    """
    slot = lambda c: F.floor(F.unix_timestamp(c) / 3600)
    spread = answers.withColumn("hour", F.explode(F.sequence(slot("at"), slot("at") + hours)))
    met = spread.join(runs.withColumn("hour", slot("ran")), ["key", "hour"]).where((F.col("ran") >= F.col("at")) & (F.unix_timestamp("ran") <= F.unix_timestamp("at") + hours * 3600))
    of_run = met.groupBy("run_id").agg(F.max_by(F.struct("answer_id", "at", "ran"), F.struct("at", "answer_id")).alias("m")).select("run_id", "m.*")
    return of_run.groupBy("answer_id").agg(F.min_by("run_id", F.struct("ran", "run_id")).alias("run_id"))


def history(chats: DataFrame, now: Column, key: str, most: int = HISTORY, days: int = HISTORY_DAYS) -> DataFrame:
    return chats.where(F.unix_timestamp(now) - F.unix_timestamp("ts") <= days * 86400).orderBy(F.desc("ts"), key).limit(most)


def within_bytes(rows: DataFrame, scope: str, order: list[Column], size: str, most_rows: int, most_bytes: int) -> DataFrame:
    """The first rows of each scope while their number and running size allow."""
    w = Window.partitionBy(scope).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).withColumn("total", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("place") <= most_rows) & (F.col("total") <= most_bytes))


def scoped_instructions(rows: DataFrame) -> DataFrame:
    """Instructions (text, database, enabled, created) that apply: one row a text, global ones first, then by creation."""
    live = rows.where("enabled AND trim(text) <> ''")
    return live.groupBy("text").agg(F.bool_or(F.col("database").isNull()).alias("everywhere"), F.min("created").alias("created"), F.array_join(F.sort_array(F.collect_set("database")), ",").alias("databases")).orderBy(F.desc("everywhere"), "created", "text")
