"""What is known, folded from a log that can be undone.

A log has `learn` (a value for a key, from a source of some rank), `forget` (a key's values up to then) and `undo` (the
event `target`, which may be an undo itself). The state of a key is the latest value of the highest rank that stands: a
value from a weaker source than the present one is refused, an equal or stronger one replaces it, and what it replaced comes
back when it is undone. All of it is sums and maxima per key and value, so no key's events come together in a task, and
parts of a log can be folded before: a snapshot keeps one row for each key and value of what is final, and later events go
on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.text import tokens
from tidemill.operators.stored import stored

COLUMNS = ["key", "seq", "kind", "value", "rank", "target", "n"]
KINDS = ("learn", "forget", "undo")
RANKS, REPLACED, QUESTIONS = (0, 5), 5, 8
MOST_ROUNDS = 32


def sanitised(log: DataFrame) -> DataFrame:
    """COLUMNS of a log's rows that make sense: with a number and a known kind, a key, and what the kind needs; ranks within
    RANKS, counts of at least 1. Of rows with one number the least is taken."""
    have = lambda c, kind: (F.col(c) if c in log.columns else F.lit(None)).cast(kind).alias(c)
    rows = log.select(F.trim(have("key", "string")).alias("key"), have("seq", "long"), have("kind", "string"), have("value", "string"), have("rank", "int"), have("target", "long"), have("n", "long"))
    rank = F.least(F.greatest(F.coalesce("rank", F.lit(RANKS[0])), F.lit(RANKS[0])), F.lit(RANKS[1]))
    rows = rows.withColumn("rank", rank).withColumn("n", F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)))
    sound = F.when(F.col("kind") == "undo", F.col("target") < F.col("seq")).when(F.col("kind") == "forget", F.col("key") != "").when(F.col("kind") == "learn", (F.col("key") != "") & F.col("value").isNotNull())
    rows = rows.where(F.col("seq").isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.groupBy("seq").agg(F.min(F.struct(*[c for c in COLUMNS if c != "seq"])).alias("e")).select("e.key", "seq", *[f"e.{c}" for c in COLUMNS[2:]])


def standing(log: DataFrame) -> DataFrame:
    """The log's learn and forget rows that no standing undo is about. Undos are settled from the last ones backwards: one
    that no other is about stands, and what it is about does not."""
    undos = stored(log.where("kind = 'undo'").select("seq", "target"), "fold-undos")
    open_, void = undos, undos.select(F.col("target").alias("seq")).limit(0)
    for _ in range(MOST_ROUNDS):
        # undos that none of the open ones is about stand now; what they are about is void, and open no more
        about = open_.select(F.col("target").alias("seq")).distinct()
        stands = open_.join(about, "seq", "left_anti")
        gone = stored(stands.select(F.col("target").alias("seq")).distinct(), "fold-void")
        void = void.unionByName(gone)
        open_ = stored(open_.join(stands.select("seq"), "seq", "left_anti").join(gone, "seq", "left_anti"), "fold-open")
        if open_.limit(1).count() == 0:
            return log.where("kind <> 'undo'").join(void.distinct(), "seq", "left_anti")
    raise RuntimeError(f"undos are about undos more than {MOST_ROUNDS} times")


def remembered(rows: DataFrame) -> DataFrame:
    """key, value, rank, seq (of its strongest and then latest event), n: of standing rows, those after their key's last forget."""
    forgot = rows.where("kind = 'forget'").groupBy("key").agg(F.max("seq").alias("upto"))
    learnt = rows.where("kind = 'learn'").join(forgot, "key", "left").where("upto IS NULL OR seq > upto")
    each = learnt.groupBy("key", "value").agg(F.max(F.struct("rank", "seq")).alias("top"), F.sum("n").alias("n"))
    return each.select("key", "value", "top.rank", "top.seq", "n")


def state(log: DataFrame) -> DataFrame:
    """key, value, rank, seq, uses, replaced (the values before it, the last first, REPLACED at most) of a sanitised log."""
    order = Window.partitionBy("key").orderBy(F.desc("rank"), F.desc("seq"))
    top = remembered(standing(log)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= REPLACED + 1)
    values = F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"])
    now = lambda c: F.max(F.when(F.col("place") == 1, F.col(c)))
    rows = top.groupBy("key").agg(now("value").alias("value"), now("rank").alias("rank"), now("seq").alias("seq"), now("n").alias("uses"), values.alias("v"))
    return rows.select("key", "value", "rank", "seq", "uses", F.slice("v", 2, REPLACED).alias("replaced"))


def snapshot(log: DataFrame, upto: int) -> DataFrame:
    """A log with the same state, in which what is up to `upto` is one row for each key and value. From then on nothing up
    to it can be undone: later undos of it are left out."""
    old = log.where(F.col("seq") <= upto)
    rows = remembered(standing(old)).select("key", "seq", F.lit("learn").alias("kind"), "value", "rank", F.lit(None).cast("long").alias("target"), "n")
    later = log.where((F.col("seq") > upto) & ((F.col("kind") != "undo") | (F.col("target") > upto)))
    return rows.unionByName(later.select(*COLUMNS))


def continued(snapshot_: DataFrame, more: DataFrame, upto: int) -> DataFrame:
    """The state of a snapshot (taken at `upto`) and a log of later events."""
    return state(snapshot_.unionByName(more.where((F.col("seq") > upto) & ((F.col("kind") != "undo") | (F.col("target") > upto))).select(*COLUMNS)))


def domains(log: DataFrame, members: DataFrame) -> DataFrame:
    """path, description, rank, tables: domains whose descriptions are a log's values, with all tables (key, seq, table) that
    standing events brought; those of weaker sources add tables, but no description."""
    rows = stored(standing(log), "fold-standing")
    forgot = rows.where("kind = 'forget'").groupBy("key").agg(F.max("seq").alias("upto"))
    of = members.join(rows.where("kind = 'learn'").select("seq"), "seq").join(forgot, "key", "left").where("upto IS NULL OR seq > upto")
    tables = of.groupBy("key").agg(F.sort_array(F.collect_set("table")).alias("tables"))
    best = remembered(rows).groupBy("key").agg(F.max_by(F.struct("value", "rank"), F.struct("rank", "seq")).alias("b"))
    none = F.array().cast("array<string>")
    return best.join(tables, "key", "left").select(F.col("key").alias("path"), F.col("b.value").alias("description"), "b.rank", F.coalesce("tables", none).alias("tables"))


def runbook(runs: DataFrame) -> DataFrame:
    """id, name, sql, questions, runs: kept queries (seq, name, shape, sql, question) that share a shape or a name (its
    tokens) are one entry, over any number of steps; it has the latest name and text, and the last QUESTIONS questions."""
    name = F.array_join(tokens(F.col("name")), " ")
    rows = runs.select("seq", "name", "sql", "question", F.concat(F.lit("n:"), name).alias("a"), F.concat(F.lit("s:"), "shape").alias("b"))
    links = stored(rows.groupBy("a", "b").agg(F.min("seq").alias("label")), "runbook-links")
    for _ in range(MOST_ROUNDS):
        by_a = links.groupBy("a").agg(F.min("label").alias("x"))
        near = links.join(by_a, "a").groupBy("b").agg(F.min("x").alias("y"))
        new = stored(links.join(near, "b").select("a", "b", F.least("label", "y").alias("label")), "runbook-links")
        moved = new.join(links.withColumnRenamed("label", "was"), ["a", "b"]).where("label < was").limit(1).count()
        links = new
        if not moved:
            break
    else:
        raise RuntimeError(f"entries still grow together after {MOST_ROUNDS} rounds")
    of = rows.join(links, ["a", "b"])
    entry = of.groupBy("label").agg(F.max_by(F.struct("name", "sql"), "seq").alias("e"), F.count(F.lit(1)).alias("runs"))
    asked = of.where("question IS NOT NULL").groupBy("label", "question").agg(F.max("seq").alias("seq"))
    last = asked.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("seq")))).where(F.col("place") <= QUESTIONS)
    asked = last.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "question"))), lambda x: x["question"]).alias("questions"))
    none = F.array().cast("array<string>")
    return entry.join(asked, "label", "left").select(F.concat(F.lit("q"), "label").alias("id"), "e.name", "e.sql", F.coalesce("questions", none).alias("questions"), "runs")
