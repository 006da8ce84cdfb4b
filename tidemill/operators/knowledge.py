"""Facts learnt from runs, what of them fits a question, and outlines of a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.ranking import bm25
from tidemill.operators.usage import TRUST

HISTORY, CONFIRMED = 5, 0.05


def uncached(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct texts (text) that a cache of embeddings (model, key) lacks, with their keys."""
    rows = texts.select("text").where("text IS NOT NULL").distinct().withColumn("key", F.sha1("text"))
    return rows.join(cache.where(F.col("model") == model).select("key"), "key", "left_anti")


def _of_source(rank: Column, place: int) -> Column:
    return F.element_at(F.create_map(*[x for r in TRUST for x in (F.lit(r[1]), F.lit(r[place]))]), rank)


def learnt(events: DataFrame) -> DataFrame:
    """Facts from (name, meaning, rank, ts), each name's in time: the same meaning confirms, another one replaces it if its
    source is trusted as much or more, else it is refused. Up to HISTORY replaced meanings are kept.

    A fold needs a name's events in order; they are what people said of one name, so few.
    """
    start = F.struct(F.lit(None).cast("string").alias("meaning"), F.lit(-1).alias("rank"), F.lit(0.0).alias("confidence"), F.lit(0).alias("confirmed"), F.lit(0).alias("refused"), F.array().cast("array<string>").alias("replaced"))

    def step(a: Column, e: Column) -> Column:
        state = lambda m, r, c, n, x, h: F.struct(m.alias("meaning"), r.alias("rank"), c.alias("confidence"), n.alias("confirmed"), x.alias("refused"), h.alias("replaced"))
        top = F.greatest(a["rank"], e["rank"])
        same = state(a["meaning"], top, F.least(_of_source(top, 3), a["confidence"] + CONFIRMED), a["confirmed"] + 1, a["refused"], a["replaced"])
        old = F.concat(a["replaced"], F.array(a["meaning"]))
        kept = F.when(a["meaning"].isNull(), a["replaced"]).otherwise(F.slice(old, F.greatest(F.size(old) - HISTORY + 1, F.lit(1)), F.lit(HISTORY)))
        new = state(e["meaning"], e["rank"], _of_source(e["rank"], 2), a["confirmed"], a["refused"], kept)
        refused = state(a["meaning"], a["rank"], a["confidence"], a["confirmed"], a["refused"] + 1, a["replaced"])
        return F.when(a["meaning"].eqNullSafe(e["meaning"]), same).when(e["rank"] >= a["rank"], new).otherwise(refused)

    told = F.sort_array(F.collect_list(F.struct("ts", "rank", "meaning")))
    return events.groupBy("name").agg(told.alias("told")).select("name", F.aggregate("told", start, step).alias("s")).select("name", "s.*")


def outline(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """name, domain: tables by the first word of their names; one alone joins the domain it has most edges to, or none."""
    word = F.element_at(F.split(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1_$2"), "[_.]"), 1)
    rows = tables.select("name", F.lower(word).alias("domain"))
    sizes = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    groups = rows.join(sizes, "domain")
    whole, alone = groups.where("n >= 2").select("name", "domain"), groups.where("n = 1").select("name")
    both = edges.selectExpr("from_table AS name", "to_table AS other").unionByName(edges.selectExpr("to_table AS name", "from_table AS other"))
    votes = alone.join(both, "name").join(whole.select(F.col("name").alias("other"), "domain"), "other").groupBy("name", "domain").agg(F.count(F.lit(1)).alias("votes"))
    joined = votes.groupBy("name").agg(F.min_by("domain", F.struct((-F.col("votes")).alias("v"), "domain")).alias("domain"))
    return whole.unionByName(joined)


def rendered(lines: DataFrame) -> DataFrame:
    """One text of lines (table, line), in the order of tables."""
    return lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("table", "line"))), lambda x: x["line"]), "\n").alias("text"))


def found_again(ranked: DataFrame, shown: DataFrame, columns: DataFrame, terms: list[str], least: int = 3, most: int = 20) -> DataFrame:
    """Ranked tables (table, score) that are not shown; if fewer than `least`, also those with a column like one of the first four terms."""
    rest = ranked.join(shown.select("table"), "table", "left_anti")
    few = rest.agg((F.count(F.lit(1)) < least).alias("few"))
    test = F.lit(False)
    for term in terms[:4]:
        test = test | F.lower("column").contains(term.lower())
    more = columns.where(test).select("table").distinct().join(shown.select("table"), "table", "left_anti").join(rest.select("table"), "table", "left_anti").orderBy("table").limit(most)
    return rest.unionByName(more.join(F.broadcast(few), F.col("few")).select("table", F.lit(0.0).alias("score")))


def recalled_rules(rules: DataFrame, words: Column, most: int = 6) -> DataFrame:
    """Rules (name, tokens, confidence, weight): 10 for each word hit, 5 times the confidence, and the weight."""
    hits = F.size(F.array_intersect(F.array_distinct("tokens"), words))
    return rules.where(hits > 0).withColumn("score", 10 * hits + 5 * F.col("confidence") + F.col("weight")).orderBy(F.desc("score"), "name").limit(most)


def recalled_values(values: DataFrame, question: Column, most: int = 8) -> DataFrame:
    """Values (value, column, weight) of three characters or more that the question names."""
    named = F.concat(F.lit(" "), F.regexp_replace(F.lower(question), "[^\\p{L}\\p{N}]+", " "), F.lit(" "))
    own = F.concat(F.lit(" "), F.regexp_replace(F.lower("value"), "[^\\p{L}\\p{N}]+", " "), F.lit(" "))
    return values.where((F.length("value") >= 3) & named.contains(own)).orderBy(F.desc("weight"), "column", "value").limit(most)


def recalled_flows(links: DataFrame, seeds: DataFrame, most: int = 8) -> DataFrame:
    """Links (a, b, kind, weight) that touch a seed (table); those that carry data come before joins."""
    s = seeds.select("table").distinct()
    touch = links.join(s, links["a"] == s["table"], "left_semi").unionByName(links.join(s, links["b"] == s["table"], "left_semi")).distinct()
    return touch.orderBy((F.col("kind") == "join"), F.desc("weight"), "a", "b").limit(most)


def recalled_examples(queries: DataFrame, words: Column, saved: DataFrame, most: int = 2) -> DataFrame:
    """Queries (shape, tokens, runs, errors, weight, question) that did not always fail and are not saved ones."""
    score = F.size(F.array_intersect(F.array_distinct("tokens"), words)) + F.col("weight") + F.col("question").isNotNull().cast("int")
    return queries.where("errors < runs").join(saved.select("shape"), "shape", "left_anti").withColumn("score", score).orderBy(F.desc("score"), "shape").limit(most)


def recalled_runbook(entries: DataFrame, words: DataFrame, most: int = 3) -> DataFrame:
    """name, hits, coverage, score of entries (name, tokens, runs, failures) that share two words or more of three letters
    with a question (token), and three tenths of them; ranked as documents are. Entries that fail more than they run, and
    three times or more, are left out."""
    usable = entries.where("NOT (failures >= 3 AND failures > runs)")
    asked = words.select("token").distinct().agg(F.collect_set(F.when(F.length("token") >= 3, F.col("token"))).alias("asked"))
    hits = F.size(F.array_intersect(F.array_distinct("tokens"), F.col("asked")))
    rows = usable.crossJoin(F.broadcast(asked)).withColumn("hits", hits).withColumn("coverage", F.col("hits") / F.greatest(F.size("asked"), F.lit(1)))
    rows = rows.where("hits >= 2 AND coverage >= 0.3").join(bm25(usable, words, "name", "tokens"), "name", "left")
    rows = rows.withColumn("score", F.coalesce("score", F.lit(0.0)))
    return rows.orderBy(F.desc("score"), F.desc("hits"), F.desc("runs"), "name").limit(most).select("name", "hits", "coverage", "score")


def recalled_domains(domains: DataFrame, words: Column, seeds: DataFrame, most: int = 4) -> DataFrame:
    """path, score, named of domains (path, tokens, tables, structural): 3 for each word that names one, 2 for each seed
    (table) that it holds, and 1 if it was learnt. named: tables that it brings along, if it scores 3 or more."""
    held = domains.select("path", F.explode("tables").alias("table")).join(seeds.select("table").distinct(), "table").groupBy("path").agg(F.countDistinct("table").alias("holds"))
    hit = F.size(F.array_intersect(F.array_distinct("tokens"), words))
    rows = domains.join(held, "path", "left").withColumn("holds", F.coalesce("holds", F.lit(0))).withColumn("hit", hit).where("hit > 0 OR holds > 0")
    rows = rows.withColumn("score", 3 * F.col("hit") + 2 * F.col("holds") + F.when(F.col("structural"), 0).otherwise(1))
    brought = F.when(F.col("score") >= 3, F.slice("tables", 1, 6)).otherwise(F.array().cast("array<string>"))
    return rows.orderBy(F.desc("score"), "path").limit(most).select("path", "score", brought.alias("named"))


def sections(parts: DataFrame, head: str, most: int = 6000) -> DataFrame:
    """text: a head and parts (place, text) in order, each whole or, if it would not fit, not at all. Null without parts."""
    rows = F.sort_array(F.collect_list(F.struct("place", "text")))
    add = lambda a, p: F.when(F.length(a) + F.length(p["text"]) > most, a).otherwise(F.concat(a, F.lit("\n"), p["text"]))
    return parts.agg(rows.alias("rows")).select(F.when(F.size("rows") > 0, F.aggregate("rows", F.lit(head), add)).alias("text"))


def table_notes(domains: DataFrame, terms: DataFrame, runbook: DataFrame, links: DataFrame, table: str) -> DataFrame:
    """place, note about a table: its domains (path, tables), six terms (name, table, weight), four runbook entries (name,
    table, runs) and six links (a, b, weight) at most."""
    pick = lambda df, order, n, note, place: df.orderBy(*order).limit(n).select(F.lit(place).alias("place"), note.alias("note"))
    other = F.when(F.col("a") == table, F.concat(F.lit("feeds "), F.col("b"))).otherwise(F.concat(F.lit("fed by "), F.col("a")))
    return (
        pick(domains.where(F.array_contains("tables", table)), ["path"], 3, F.concat(F.lit("domain "), "path"), 0)
        .unionByName(pick(terms.where(F.col("table") == table), [F.desc("weight"), "name"], 6, F.concat(F.lit("term "), "name"), 1))
        .unionByName(pick(runbook.where(F.col("table") == table), [F.desc("runs"), "name"], 4, F.concat(F.lit("runbook "), "name"), 2))
        .unionByName(pick(links.where((F.col("a") == table) | (F.col("b") == table)), [F.desc("weight"), "a", "b"], 6, other, 3))
    )
