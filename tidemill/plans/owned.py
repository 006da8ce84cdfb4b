"""Queries of the library's own operators: name -> (function, DuckDB text or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import text as X
from tidemill.functions import validators as V
from tidemill.operators import edits, folds, knowledge, lineage, paging, ranking, sampling, usage, vectors
from tidemill.operators.privacy import csvtext, detect, markers, policy, protect, requests, values, vault
from tidemill.operators.stored import scratch
from tidemill.plans import catalog, script
from tidemill.streaming import answers, stateful

QUERIES: dict[str, tuple] = {}


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


# --- scans and pages ---


@query("a04_sort_page", "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 200 OFFSET 200")
def a04(spark, d):
    return paging.page(t(spark, d, "orders"), "o_orderstatus = 'F' AND o_totalprice > 1000", "o_totalprice", True, 200, 200, ["o_orderkey"])


@query("a05_projection", "SELECT c_custkey, c_mktsegment FROM customer")
def a05(spark, d):
    df = t(spark, d, "customer")
    hidden = df.select("c_custkey", "c_mktsegment", df["c_name"].alias("c_name", metadata={"hidden": 1}))
    return paging.visible(hidden)


@query("a06_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_totalprice < 2000")
def a06(spark, d):
    return paging.filtered(t(spark, d, "orders"), " o_orderpriority = '1-URGENT' OR o_totalprice < 2000 ").select("o_orderkey", "o_custkey")


@query("a08_clamped", "SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 1")
def a08(spark, d):
    return paging.page(t(spark, d, "part").select("p_partkey", "p_size"), None, "p_size", False, -5, 0, ["p_partkey"])


@query("a09_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def a09(spark, d):
    return paging.counted(t(spark, d, "orders"), "o_orderstatus = 'F' AND o_totalprice > 1000")


@query("a10_distinct_sample", "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL")
def a10(spark, d):
    return paging.distinct_sample(t(spark, d, "customer"), "c_mktsegment")


@query("a11_sample_columns", "WITH v AS (SELECT DISTINCT 'o_orderstatus' AS c, o_orderstatus AS v FROM orders UNION SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders) SELECT c AS \"column\", string_agg(v, '|' ORDER BY v) AS \"values\" FROM v GROUP BY c")
def a11(spark, d):
    return paging.sampled(t(spark, d, "orders"))


@query("a13_truncated", "SELECT count(*) > 1000 AS truncated, least(count(*), 1000) AS rows FROM (SELECT 1 FROM lineitem LIMIT 1001)")
def a13(spark, d):
    return paging.truncated(t(spark, d, "lineitem").select("l_orderkey"), 0)[1]


@query("a20_infer_types", "SELECT 'k' AS \"column\", CASE WHEN count(*) FILTER (WHERE NOT regexp_matches(v, '^[+-]?[0-9]{1,18}$')) = 0 THEN 'INTEGER' END AS storage FROM (SELECT json_extract_string(props, '$.k') AS v FROM events) WHERE v IS NOT NULL")
def a20(spark, d):
    return paging.inferred_types(t(spark, d, "events").select(F.get_json_object("props", "$.k").alias("k")), "k")


@query("a30_keyset_page", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey > 50 OR (l_orderkey = 50 AND l_linenumber > 1) ORDER BY l_orderkey, l_linenumber LIMIT 101")
def a30(spark, d):
    after = paging.cursor({"l_orderkey": 50, "l_linenumber": 1})
    return paging.keyset_page(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"], 101, after)


@query("a31_name_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') ORDER BY starts_with(lower(p_name), 'an') DESC, lower(p_name), p_name, p_partkey LIMIT 100000")
def a31(spark, d):
    return paging.searched(t(spark, d, "part").select("p_partkey", "p_name"), "p_name", " AN ", 100_000)


@query("a34_of_refs", "SELECT * FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def a34(spark, d):
    return paging.of_refs(t(spark, d, "nation"), t(spark, d, "region").where("r_name LIKE 'A%'").select(F.col("r_regionkey").alias("n_regionkey")), ["n_regionkey"])


EDGE_VALUES = ", ".join("('{}', '{}', '{}', '{}')".format(*a.split("."), *b.split(".")) for a, b in (e.split("=") for e in catalog.EDGES))
EDGE_SQL = f"(VALUES {EDGE_VALUES}) e(from_table, from_column, to_table, to_column)"


@query("a35_fk_touching", f"SELECT * FROM {EDGE_SQL} WHERE from_table IN ('orders', 'nation') OR to_table IN ('orders', 'nation')")
def a35(spark, d):
    return paging.touching(catalog.edges(spark), spark.createDataFrame([("orders",), ("nation",)], "name string"))


@query("a29_column_counts", "SELECT table_name AS \"table\", count(*) AS columns, count(*) FILTER (WHERE data_type = 'VARCHAR') AS texts FROM information_schema.columns WHERE table_schema = 'main' AND table_name IN (" + ", ".join(f"'{n}'" for n in catalog.TABLES) + ") GROUP BY table_name")
def a29(spark, d):
    cols = catalog.columns({n: t(spark, d, n) for n in catalog.TABLES})
    return cols.groupBy("table").agg(F.count(F.lit(1)).alias("columns"), F.count_if(F.col("type") == "string").alias("texts"))


TYPES_SQL = "CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END"


@query("d13_schema_lines", f"WITH c AS (SELECT table_name AS t, ordinal_position AS i, column_name AS c, {TYPES_SQL} AS k FROM information_schema.columns WHERE table_schema = 'main' AND table_name IN (" + ", ".join(f"'{n}'" for n in catalog.TABLES) + f")), r AS (SELECT from_table AS t, from_column AS c, ' fk->' || to_table AS ref FROM {EDGE_SQL}) SELECT t AS \"table\", t || '(' || string_agg(c || ' ' || k || coalesce(ref, ''), ', ' ORDER BY i) || ')' AS line FROM c LEFT JOIN r USING (t, c) GROUP BY t")
def d13(spark, d):
    return catalog.lines(catalog.columns({n: t(spark, d, n) for n in catalog.TABLES}), catalog.edges(spark))


@query("d16_referenced_by", f"SELECT to_table AS \"table\", string_agg(from_table || '.' || from_column, ', ' ORDER BY from_table || '.' || from_column) AS referenced_by FROM {EDGE_SQL} GROUP BY to_table")
def d16(spark, d):
    return catalog.referenced_by(catalog.edges(spark))


# --- ranking ---

PARTING = X.PARTING.replace("'", "''")
STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
TOKENS_SQL = f"""
w AS (SELECT id, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(txt, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '{PARTING}', ' ', 'g')), '\\s+'), lambda x: length(x) >= 2 AND NOT list_contains([{STOPS}], x)) AS ws FROM src),
tok AS (SELECT id, flatten(list_transform(ws, lambda x: CASE WHEN length(x) <= 3 THEN [x] WHEN suffix(x, 'ies') THEN [x, x[1:length(x) - 3] || 'y'] WHEN regexp_matches(x, '(s|x|z|ch|sh)es$') THEN [x, x[1:length(x) - 2]] WHEN suffix(x, 's') AND NOT suffix(x, 'ss') THEN [x, x[1:length(x) - 1]] ELSE [x] END)) AS toks FROM w)
"""


def documents_tokens(spark, d):
    return t(spark, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("toks"))


@query("d01_tokens", f"WITH src AS (SELECT doc_id AS id, text AS txt FROM documents), {TOKENS_SQL} SELECT id AS doc_id, CAST(len(toks) AS INTEGER) AS n, md5(array_to_string(toks, ' ')) AS digest FROM tok")
def d01(spark, d):
    return documents_tokens(spark, d).select("doc_id", F.size("toks").alias("n"), F.md5(F.array_join("toks", " ")).alias("digest"))


@query("c21_functions", f"WITH src AS (SELECT doc_id AS id, text AS txt FROM documents), {TOKENS_SQL} SELECT id AS doc_id, CAST(len(toks) AS INTEGER) AS n, '4567' AS masked FROM tok")
def c21(spark, d):
    script.register_functions(spark)
    t(spark, d, "documents").createOrReplaceTempView("__c21")
    return spark.sql("SELECT doc_id, size(text_tokens(text)) AS n, mask_value('+1 234-4567') AS masked FROM __c21")


@query("d02_token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def d02(spark, d):
    return t(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("d03_postings", f"WITH src AS (SELECT doc_id AS id, text AS txt FROM documents), {TOKENS_SQL}, p AS (SELECT id, unnest(toks) AS token FROM tok), q AS (SELECT id, token, count(*) AS tf FROM p GROUP BY id, token) SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM q GROUP BY token")
def d03(spark, d):
    return ranking.postings(documents_tokens(spark, d), "doc_id", "toks").groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


BM25_SQL = f"""
WITH src AS (SELECT doc_id AS id, text AS txt FROM documents), {TOKENS_SQL},
qs AS (SELECT item_id AS id, text AS txt FROM benchmark WHERE item_id = 0),
qw AS (SELECT unnest(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(txt, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '{PARTING}', ' ', 'g')), '\\s+'), lambda x: length(x) >= 2 AND NOT list_contains([{STOPS}], x))) AS x FROM qs),
q AS (SELECT DISTINCT unnest(CASE WHEN length(x) <= 3 THEN [x] WHEN suffix(x, 'ies') THEN [x, x[1:length(x) - 3] || 'y'] WHEN regexp_matches(x, '(s|x|z|ch|sh)es$') THEN [x, x[1:length(x) - 2]] WHEN suffix(x, 's') AND NOT suffix(x, 'ss') THEN [x, x[1:length(x) - 1]] ELSE [x] END) AS token FROM qw),
n AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_len FROM tok),
p AS (SELECT id, len(toks) AS doc_len, unnest(toks) AS token FROM tok),
tf AS (SELECT id, doc_len, token, count(*) AS tf FROM p WHERE token IN (SELECT token FROM q) GROUP BY id, doc_len, token),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token)
SELECT id AS doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score FROM tf JOIN df USING (token), n GROUP BY id
"""


@query("d04_bm25", BM25_SQL)
def d04(spark, d):
    q = t(spark, d, "benchmark").where("item_id = 0").select(F.explode(X.tokens(F.col("text"))).alias("token"))
    return ranking.bm25(documents_tokens(spark, d), q, "doc_id", "toks").select("doc_id", F.round("score", 6).alias("score"))


COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def nearest(spark, d):
    v = t(spark, d, "embeddings")
    one = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return v.join(F.broadcast(one)).select("vec_id", ranking.cosine(F.col("embedding"), F.col("q")).alias("score"))


@query("d06_cosine", f"SELECT b.vec_id, round({COSINE}, 5) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0")
def d06(spark, d):
    return nearest(spark, d).select("vec_id", F.round("score", 5).alias("score"))


@query("d07_rrf", f"WITH l AS (SELECT vec_id, row_number() OVER (ORDER BY label DESC, vec_id) - 1 AS p FROM embeddings ), s AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS q FROM (SELECT b.vec_id, round({COSINE}, 5) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0) QUALIFY q < 50) SELECT vec_id, round(coalesce(1 / (60 + p), 0) + coalesce(1 / (60 + q), 0), 8) AS score FROM l FULL JOIN s USING (vec_id)")
def d07(spark, d):
    lexical = t(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("score"))
    semantic = nearest(spark, d).select("vec_id", F.round("score", 5).alias("score"))
    return ranking.fused(lexical, semantic, "vec_id").select("vec_id", F.round("score", 8).alias("score"))


# the same for every query row of the job: ids divisible by 20

BM25_ALL_SQL = f"""
WITH src AS (SELECT doc_id AS id, text AS txt FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark WHERE item_id % 20 = 0), {TOKENS_SQL},
q AS (SELECT DISTINCT -1 - id AS item_id, unnest(toks) AS token FROM tok WHERE id < 0), d AS (SELECT * FROM tok WHERE id >= 0),
n AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_len FROM d),
p AS (SELECT id, len(toks) AS doc_len, unnest(toks) AS token FROM d),
tf AS (SELECT id, doc_len, token, count(*) AS tf FROM p WHERE token IN (SELECT token FROM q) GROUP BY id, doc_len, token),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token)
SELECT item_id, id AS doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score FROM tf JOIN df USING (token) JOIN q USING (token), n GROUP BY item_id, id
"""


@query("d04_bm25_all", BM25_ALL_SQL)
def d04_all(spark, d):
    q = t(spark, d, "benchmark").where("item_id % 20 = 0").select("item_id", F.explode(X.tokens(F.col("text"))).alias("token"))
    return ranking.bm25(documents_tokens(spark, d), q, "doc_id", "toks", "item_id").select("item_id", "doc_id", F.round("score", 6).alias("score"))


def all_nearest(spark, d, most=None):
    v = t(spark, d, "embeddings")
    found = ranking.cosines(v, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), "vec_id", "embedding", "query_id", most)
    return found.withColumn("score", F.round("score", 5))


@query("d06_cosine_all", f"SELECT a.vec_id AS query_id, b.vec_id, round({COSINE}, 5) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0")
def d06_all(spark, d):
    return all_nearest(spark, d)


@query("d07_rrf_all", f"WITH l AS (SELECT vec_id, row_number() OVER (ORDER BY label DESC, vec_id) - 1 AS p FROM embeddings), s AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS q FROM (SELECT a.vec_id AS query_id, b.vec_id, round({COSINE}, 5) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) QUALIFY q < 50), x AS (SELECT e.vec_id AS query_id, l.* FROM embeddings e, l WHERE e.vec_id % 20 = 0) SELECT query_id, vec_id, round(1 / (60 + p) + coalesce(1 / (60 + q), 0), 8) AS score FROM x LEFT JOIN s USING (query_id, vec_id)")
def d07_all(spark, d):
    v = t(spark, d, "embeddings")
    lexical = v.select("vec_id", F.col("label").cast("double").alias("score"))
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").cast("long").alias("query_id"))
    return ranking.fused(lexical, all_nearest(spark, d, ranking.SEMANTIC), "vec_id", queries=asked, digits=8)


@query("d22_nearest", f"SELECT a.vec_id AS query, b.vec_id AS id, round({COSINE}, 6) AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COSINE}, 6) DESC, b.vec_id) AS INTEGER) AS place FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY place <= 10")
def d22(spark, d):
    """The ten nearest vectors of each whose id is divisible by 20, among all, through the index."""
    v = t(spark, d, "embeddings")
    return vectors.Index(v, lists=64).search(v.where("vec_id % 20 = 0"), 10, exact=True)


@query("d08_whole_schema", "SELECT n_name AS name, CAST(ceil(length(n_name) / 4) AS BIGINT) AS tokens FROM nation WHERE (SELECT sum(ceil(length(n_name) / 4)) FROM nation) <= 100000")
def d08(spark, d):
    return ranking.whole_schema(t(spark, d, "nation").select(F.col("n_name").alias("name"), X.token_estimate(F.col("n_name")).alias("tokens")), 100_000)


@query("d09_boosts", "WITH s AS (SELECT source AS name, CAST(max(n_chars) AS DOUBLE) AS score FROM documents WHERE source IS NOT NULL GROUP BY source), m AS (SELECT max(score) AS top FROM s), k AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM s QUALIFY i < 3), r AS (SELECT max(name) AS name FROM s) SELECT s.name, round(score + top * (coalesce(1.5 - 0.05 * i, 0) + CASE WHEN r.name IS NULL THEN 0 ELSE 0.5 END), 6) AS score FROM s JOIN m ON true LEFT JOIN k ON k.name = s.name LEFT JOIN r ON r.name = s.name")
def d09(spark, d):
    scores = t(spark, d, "documents").where("source IS NOT NULL").groupBy(F.col("source").alias("name")).agg(F.max("n_chars").cast("double").alias("score"))
    known = scores.orderBy("name").limit(3).select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("place"))
    return ranking.boosted(scores, scores.agg(F.max("name").alias("name")), known).select("name", F.round("score", 6).alias("score"))


@query("d10_hubs", f"WITH b AS (SELECT from_table AS name, to_table AS other FROM {EDGE_SQL} UNION SELECT to_table, from_table FROM {EDGE_SQL}) SELECT name, CAST(0 AS BIGINT) AS n_rows, count(DISTINCT other) AS degree FROM b GROUP BY name ORDER BY degree DESC, name LIMIT 8")
def d10(spark, d):
    e = catalog.edges(spark)
    names = e.selectExpr("from_table AS name").union(e.selectExpr("to_table AS name")).distinct().withColumn("n_rows", F.lit(0).cast("long"))
    return ranking.hubs(e, names)


@query("d11_fk_hops", "SELECT * FROM (VALUES ('orders', 2.0, 0), ('customer', 1.2, 1), ('lineitem', 1.2, 1), ('nation', 0.24, 3), ('part', 0.24, 3), ('supplier', 0.24, 3)) v(name, score, step)")
def d11(spark, d):
    scores = spark.createDataFrame([("orders", 2.0)], "name string, score double")
    return ranking.expanded(scores, catalog.edges(spark)).select("name", F.round("score", 6).cast("decimal(10,2)").cast("double").alias("score"), "step")


@query("d14_human_count", "WITH n AS (SELECT o_orderkey, CAST(floor(o_totalprice * o_orderkey) AS DOUBLE) AS v FROM orders), s AS (SELECT o_orderkey, v, CASE WHEN v >= 1e9 THEN v / 1e9 WHEN v >= 1e6 THEN v / 1e6 WHEN v >= 1e3 THEN v / 1e3 ELSE v END AS x, CASE WHEN v >= 1e9 THEN 'B' WHEN v >= 1e6 THEN 'M' WHEN v >= 1e3 THEN 'k' ELSE '' END AS u FROM n) SELECT o_orderkey, CASE WHEN u <> '' AND x < 10 THEN regexp_replace(printf('%.1f', x), '\\.0$', '') ELSE printf('%.0f', x) END || u AS h FROM s")
def d14(spark, d):
    return t(spark, d, "orders").select("o_orderkey", X.human_count(F.floor(F.col("o_totalprice") * F.col("o_orderkey"))).alias("h"))


@query("d15_shorten", "WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents) SELECT doc_id, CASE WHEN length(x) > 120 THEN rtrim(x[1:119]) || '…' ELSE x END AS short FROM f")
def d15(spark, d):
    return t(spark, d, "documents").select("doc_id", X.shortened(F.col("text")).alias("short"))


@query("d20_resolve", "SELECT * FROM (VALUES ('orders', 'orders', 0), ('ORDERS', 'orders', 1), ('main.Part', 'part', 2)) v(asked, name, way)")
def d20(spark, d):
    names = spark.createDataFrame([("orders",), ("ORDERS",), ("main.Part",), ("nothing",)], "asked string")
    return ranking.resolved(names, spark.createDataFrame([(n,) for n in catalog.TABLES], "name string"))


@query("f07_word_overlap", "WITH b AS (SELECT item_id, list_distinct(string_split(text, ' ')) AS w FROM benchmark) SELECT a.item_id AS i, b.item_id AS j, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) AS share FROM b a JOIN b ON b.item_id = a.item_id + 1")
def f07(spark, d):
    b = t(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    return b.select(F.col("item_id").alias("i"), F.col("w").alias("v"), (F.col("item_id") + 1).alias("j")).join(b, F.col("j") == F.col("item_id")).select("i", "j", F.round(ranking.word_overlap(F.col("v"), F.col("w")), 6).alias("share"))


# --- logs ---


def runs(spark, d):
    return t(spark, d, "events").select(F.col("event_type").alias("shape"), "ts", (F.col("event_type") != "error").alias("ok"), F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("sql"), (F.col("value") > 90).alias("by_user"))


@query("f01_shape_rollup", "SELECT event_type AS shape, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS errors, CASE WHEN event_type <> 'error' THEN arg_max(event_type || ' ' || event_id, (ts, event_type || ' ' || event_id)) END AS latest_sql, min(ts) AS first_at, max(ts) AS last_at, bool_or(coalesce(value > 90, false)) AS by_user FROM events GROUP BY event_type")
def f01(spark, d):
    return usage.by_shape(runs(spark, d))


@query("f02_links", "SELECT 'join' AS kind, least(n_name, r_name) AS a, greatest(n_name, r_name) AS b, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def f02(spark, d):
    n, r, c = (t(spark, d, x) for x in ("nation", "region", "customer"))
    pairs = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return usage.links(pairs.select(F.lit("join").alias("kind"), F.col("n_name").alias("a"), F.col("r_name").alias("b")))


@query("f03_seen_values", "SELECT 'event' AS \"column\", lower(event_type) AS folded, count(*) AS n, event_type AS value FROM events WHERE event_type <> 'error' GROUP BY event_type")
def f03(spark, d):
    rows = t(spark, d, "events").select(F.lit("event").alias("column"), F.col("event_type").alias("value"), "ts", (F.col("event_type") != "error").alias("ok"))
    return usage.seen_values(rows)


WEIGHT_SQL = "log2(1 + count(*)) * pow(0.5, greatest(epoch(TIMESTAMP '2024-03-01') - floor(epoch(max(ts))), 0) / 2592000)"


def user_weights(spark, d):
    rows = t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return rows.select("user_id", F.round(usage.weight(F.col("n"), F.col("last").cast("timestamp"), F.lit("2024-03-01").cast("timestamp")), 6).alias("weight"))


@query("f04_weights", f"SELECT user_id, round({WEIGHT_SQL}, 6) AS weight FROM events GROUP BY user_id")
def f04(spark, d):
    return user_weights(spark, d)


@query("f05_retention", f"SELECT user_id, round({WEIGHT_SQL}, 6) AS weight, round({WEIGHT_SQL}, 6) AS score FROM events GROUP BY user_id ORDER BY score DESC, user_id LIMIT 150")
def f05(spark, d):
    return usage.retained(user_weights(spark, d), F.col("weight"), "user_id", usage.RETAINED["runbook"])


@query("f12_run_counters", "SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS good, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY user_id HAVING NOT (bad >= 3 AND bad > good)")
def f12(spark, d):
    rows = t(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("good"), F.count_if(F.col("event_type") == "error").alias("bad"))
    return rows.where("NOT (bad >= 3 AND bad > good)")


@query("f26_overview", "SELECT split_part(source, '1', 1) AS domain, count(DISTINCT lang) AS n_tables FROM documents GROUP BY 1 ORDER BY n_tables DESC, domain LIMIT 12")
def f26(spark, d):
    rows = t(spark, d, "documents").select(F.regexp_replace("source", "1.*", "").alias("domain"), F.col("lang").alias("table"))
    return usage.overview(rows, spark.createDataFrame([], "domain string"))


@query("f27_seeds", "SELECT source AS \"table\", CAST(max(n_chars) AS DOUBLE) AS score FROM documents GROUP BY source ORDER BY score DESC, source LIMIT 10")
def f27(spark, d):
    return usage.seeds(t(spark, d, "documents").select(F.col("source").alias("table"), F.col("n_chars").cast("double").alias("score")))


@query("f30_answer_match", "WITH m AS (SELECT r.event_id AS run_id, r.ts AS ran, arg_max(a.event_id, (a.ts, a.event_id)) AS answer_id FROM events r JOIN events a ON a.user_id = r.user_id AND a.event_type = 'view' AND r.event_type = 'click' AND r.ts >= a.ts AND floor(epoch(r.ts)) <= floor(epoch(a.ts)) + 7200 GROUP BY r.event_id, r.ts) SELECT answer_id, arg_min(run_id, (ran, run_id)) AS run_id FROM m GROUP BY answer_id")
def f30(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    a = e.where("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("event_id").alias("answer_id"), F.col("ts").alias("at"))
    r = e.where("event_type = 'click'").select(F.col("user_id").alias("key"), F.col("event_id").alias("run_id"), F.col("ts").alias("ran"))
    return usage.matched_answers(a, r)


@query("f32_history", "SELECT event_id, ts FROM events WHERE epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)) <= 30 * 86400 ORDER BY ts DESC, event_id LIMIT 30")
def f32(spark, d):
    e = t(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return usage.history(e, F.lit("2024-02-01").cast("timestamp"), "event_id").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("g53_lru_window", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER w AS p, sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id)) WHERE p <= 5 AND s <= 40")
def g53(spark, d):
    e = t(spark, d, "events").withColumn("size", F.length("props"))
    return usage.within_bytes(e, "user_id", [F.desc("ts"), F.col("event_id")], "size", 5, 40).select("user_id", "event_id")


# --- privacy ---


@query("g01_luhn", "WITH d AS (SELECT o_orderkey, CAST(o_orderkey * 7919 + 100000 AS VARCHAR) AS v FROM orders), s AS (SELECT o_orderkey, v, list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN (length(v) - i) % 2 = 1 THEN CASE WHEN 2 * CAST(v[i] AS INTEGER) > 9 THEN 2 * CAST(v[i] AS INTEGER) - 9 ELSE 2 * CAST(v[i] AS INTEGER) END ELSE CAST(v[i] AS INTEGER) END)) AS n FROM d) SELECT o_orderkey, n % 10 = 0 AS ok FROM s")
def g01(spark, d):
    return t(spark, d, "orders").select("o_orderkey", V.luhn((F.col("o_orderkey") * 7919 + 100000).cast("string")).alias("ok"))


@query("g05_aba", "WITH d AS (SELECT p_partkey, lpad(CAST((p_partkey * 7654321) % 1000000000 AS VARCHAR), 9, '0') AS v FROM part), s AS (SELECT p_partkey, v, list_transform(range(1, 10), lambda i: CAST(v[i] AS INTEGER)) AS x FROM d) SELECT p_partkey, regexp_matches(v, '^(0[0-9]|1[0-2]|2[1-9]|3[0-2]|6[1-9]|7[0-2]|80)') AND (3 * (x[1] + x[4] + x[7]) + 7 * (x[2] + x[5] + x[8]) + x[3] + x[6] + x[9]) % 10 = 0 AS ok FROM s")
def g05(spark, d):
    return t(spark, d, "part").select("p_partkey", V.aba_routing(F.lpad(((F.col("p_partkey") * 7654321) % 1000000000).cast("string"), 9, "0")).alias("ok"))


@query("g06_ssn", "WITH d AS (SELECT p_partkey, lpad(CAST((p_partkey * 9876543) % 1000000000 AS VARCHAR), 9, '0') AS v FROM part) SELECT p_partkey, NOT regexp_matches(v, '^(000|666|9)') AND NOT regexp_matches(v, '^...00') AND NOT suffix(v, '0000') AS ok FROM d")
def g06(spark, d):
    return t(spark, d, "part").select("p_partkey", V.ssn(F.lpad(((F.col("p_partkey") * 9876543) % 1000000000).cast("string"), 9, "0")).alias("ok"))


def spans_of(spark, d, kind):
    docs = t(spark, d, "documents").select("doc_id", "text")
    rows = protect.exploded(detect.detected(docs, types=[kind]), ["doc_id"])
    return rows.join(docs, "doc_id").select("doc_id", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("value"))


@query("g11_email", "SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_][A-Za-z0-9_.+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\\.[A-Za-z0-9-]{1,63}){0,6}\\.[A-Za-z]{2,24}')) AS value FROM documents")
def g11_email(spark, d):
    return spans_of(spark, d, "EMAIL_ADDRESS")


@query("g11_ipv4", "SELECT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}(?:\\.[0-9]{1,3}){3}')) AS value FROM documents) WHERE regexp_matches(value, '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.|$)){4}$')")
def g11_ipv4(spark, d):
    return spans_of(spark, d, "IP_ADDRESS")


@query("g11_patterns_all")
def g11_all(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    return protect.exploded(detect.detected(docs), ["doc_id"]).groupBy("type", "detector").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("g13_column_class", "SELECT * FROM (VALUES ('customer', 'c_custkey', 'CUSTOMER_ID'), ('nation', 'n_nationkey', NULL), ('orders', 'o_custkey', 'CUSTOMER_ID'), ('pages', 'url', 'URL')) v(\"table\", \"column\", type) WHERE type IS NOT NULL")
def g13(spark, d):
    cols = catalog.columns({n: t(spark, d, n) for n in catalog.TABLES})
    return cols.select("table", "column", detect.column_class(F.col("column")).alias("type")).where("type IS NOT NULL")


#: Rows that a task orders at once.
INTERVALS = 500_000


def intervals(spark, d):
    """As many tasks as rows ask for: Spark joins small partitions by their compressed size, which copies make small."""
    rows = t(spark, d, "lineitem")
    n = max(1, -(-rows.count() // INTERVALS))
    return rows.select(F.col("l_suppkey").alias("k"), F.floor(F.col("l_extendedprice")).cast("long").alias("start"), (F.floor(F.col("l_extendedprice")) + F.col("l_quantity")).cast("long").alias("end")).repartition(n, "k")


INTERVAL_SQL = "WITH i AS (SELECT l_suppkey AS k, CAST(floor(l_extendedprice) AS BIGINT) AS s, CAST(floor(l_extendedprice) + l_quantity AS BIGINT) AS e FROM lineitem), r AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i), c AS (SELECT *, sum(CASE WHEN reach IS NULL OR s {} reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e DESC ROWS UNBOUNDED PRECEDING) AS c FROM r) SELECT k, min(s) AS \"start\", max(e) AS \"end\", count(*) AS members FROM c GROUP BY k, c"


@query("g30_interval_union", INTERVAL_SQL.format(">="))
def g30(spark, d):
    return protect.merged(intervals(spark, d), ["k"]).groupBy("k", "cluster").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("members")).drop("cluster")


@query("i10_span_merge", INTERVAL_SQL.format(">"))
def i10(spark, d):
    return protect.merged(intervals(spark, d), ["k"], touching=True).groupBy("k", "cluster").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("members")).drop("cluster")


@query("g31_primary")
def g31(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    return protect.resolved(protect.exploded(detect.detected(docs), ["doc_id"]), ["doc_id"])


@query("g36_mask", "WITH b AS (SELECT c_custkey, regexp_replace(c_name, '[^\\p{L}\\p{N}]', '', 'g') AS v FROM customer) SELECT c_custkey, CASE WHEN length(v) >= 8 THEN right(v, 4) ELSE '' END AS masked FROM b")
def g36(spark, d):
    return t(spark, d, "customer").select("c_custkey", V.masked(F.col("c_name")).alias("masked"))


@query("g37_generalise", "SELECT p_partkey, CASE WHEN p_size + 45 >= 90 THEN '90+' ELSE CAST((p_size + 45) // 10 * 10 AS VARCHAR) || 's' END AS age FROM part")
def g37(spark, d):
    return t(spark, d, "part").select("p_partkey", V.generalised(F.lit("AGE"), (F.col("p_size") + 45).cast("string")).alias("age"))


@query("g41_pseudonyms", "WITH v AS (SELECT DISTINCT 'PERSON_NAME' AS identity, c_name AS value FROM customer), d AS (SELECT *, sha256('key' || chr(2) || sha256('key' || chr(1) || identity || chr(0) || value)) AS h FROM v), s AS (SELECT *, count(*) OVER (PARTITION BY h[1:6]) AS n FROM d) SELECT identity, value, CASE WHEN n = 1 THEN h[1:6] ELSE h[1:24] END AS pseudonym FROM s")
def g41(spark, d):
    return policy.pseudonyms(t(spark, d, "customer").select(F.lit("RELATIVE_NAME").alias("type"), F.col("c_name").alias("value")), "key")


@query("g44_protect")
def g44(spark, d):
    return protect.protected(t(spark, d, "documents").select("doc_id", "text"), "doc_id", "key")[0].select("doc_id", F.md5("text").alias("digest"))


MARKED_SQL = """
WITH v AS (SELECT DISTINCT {identity} AS identity, {value} AS value FROM {table}), d AS (SELECT *, sha256('key' || chr(2) || sha256('key' || chr(1) || identity || chr(0) || value)) AS h FROM v),
p AS (SELECT identity, value, CASE WHEN count(*) OVER (PARTITION BY h[1:6]) = 1 THEN h[1:6] ELSE h[1:24] END AS pseudonym FROM d)
"""


def planted(spark, d):
    """A text for each customer, with a mail address that others mention without what would tell its kind, and a card."""
    mail = lambda k: F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com"))
    key = F.col("c_custkey")
    return t(spark, d, "customer").select(key, F.concat(F.lit("Write to "), mail(key), F.lit(" or ask "), mail(key % 10 + 1), F.lit(", card 4111 1111 1111 1111.")).alias("text"))


@query("g44_planted", MARKED_SQL.format(identity="'EMAIL_ADDRESS'", value="'user' || k || '@example.com'", table="(SELECT c_custkey AS k FROM customer UNION SELECT c_custkey % 10 + 1 FROM customer)") + "SELECT c_custkey, 'Write to [[pii:EMAIL:' || a.pseudonym || ']] or ask [[pii:EMAIL:' || b.pseudonym || ']], card [[masked:CARD:1111]].' AS text FROM customer JOIN p a ON a.value = 'user' || c_custkey || '@example.com' JOIN p b ON b.value = 'user' || (c_custkey % 10 + 1) || '@example.com'")
def g44_planted(spark, d):
    return protect.protected(planted(spark, d), "c_custkey", "key")[0]


@query("g45_verify", "SELECT 'EMAIL_ADDRESS' AS type, 2 * count(*) AS before, CAST(0 AS BIGINT) AS after FROM customer UNION ALL SELECT 'CREDIT_CARD_NUMBER', count(*), 0 FROM customer")
def g45(spark, d):
    texts = planted(spark, d)
    before = protect.verified(texts, "c_custkey").withColumnRenamed("problems", "before")
    after = protect.verified(protect.protected(texts, "c_custkey", "key")[0], "c_custkey").withColumnRenamed("problems", "after")
    return before.join(after, "type", "full").select("type", "before", F.coalesce("after", F.lit(0).cast("long")).alias("after"))


@query("g46_restore", "SELECT doc_id, md5(text) AS digest FROM documents")
def g46(spark, d):
    """Every document: with all that is found pseudonymized, all comes back."""
    out, vault = protect.protected(t(spark, d, "documents").select("doc_id", "text"), "doc_id", "key", actions=F.lit("pseudonymize"))
    return protect.restored(out, vault, "doc_id").select("doc_id", F.md5("text").alias("digest"))


@query("g46_restore_all")
def g46_all(spark, d):
    """Every document by the policy; what was redacted or masked can't come back, so its markers stay."""
    out, vault = protect.protected(t(spark, d, "documents").select("doc_id", "text"), "doc_id", "key")
    return protect.restored(out, vault, "doc_id").select("doc_id", F.md5("text").alias("digest"))


@query("g49_columns", MARKED_SQL.format(identity="'URL'", value="url", table="pages") + "SELECT page_id, CASE WHEN url = '' THEN url ELSE '[[pii:URL:' || pseudonym || ']]' END AS url FROM pages LEFT JOIN p ON value = url")
def g49(spark, d):
    return protect.protected_columns(t(spark, d, "pages").select("page_id", "url"), "page_id", "key", ["url"])[0].select("page_id", "url")


@query("g51_report")
def g51(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    s = protect.resolved(protect.exploded(detect.detected(docs), ["doc_id"]), ["doc_id"]).join(docs, "doc_id")
    return protect.report(s.withColumn("value", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))))


@query("g54_endpoints", "SELECT page_id, regexp_matches(lower(url), '^[a-z][a-z0-9+.-]*://(localhost|127\\.[0-9.]+|\\[::1\\])([:/?#]|$)') AS local FROM pages")
def g54(spark, d):
    return t(spark, d, "pages").select("page_id", V.local_endpoint(F.col("url")).alias("local"))


@query("g64_windows", "WITH w AS (SELECT doc_id, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n FROM documents) SELECT doc_id, unnest(range(0, greatest(n - 32, 1), 224)) AS start FROM w WHERE n > 0")
def g64(spark, d):
    w = t(spark, d, "documents").select("doc_id", F.size(F.filter(F.split("text", " "), lambda x: x != "")).cast("long").alias("n")).where("n > 0")
    return w.select("doc_id", F.explode(F.expr("sequence(0L, greatest(n - 32, 1L) - 1, 224L)")).alias("start"))


# --- edits, exports, values ---


@query("h01_apply_changes", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 10 = 2 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 <> 1 UNION ALL SELECT -1, 'new', 0, 1.5, 'X'")
def h01(spark, d):
    c = t(spark, d, "customer")
    gone = c.where("c_custkey % 10 = 1").select(F.lit("delete").alias("op"), *c.columns)
    new = c.where("c_custkey % 10 = 2").select(F.lit("update").alias("op"), "c_custkey", F.lit(None).cast("string").alias("c_name"), F.lit(None).cast("int").alias("c_nationkey"), F.lit(0.0).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    more = spark.createDataFrame([("insert", -1, "new", 0, 1.5, "X")], "op string, c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    return edits.applied(c, gone.unionByName(new).unionByName(more), ["c_custkey"])


@query("h02_csv_lines", "SELECT n_nationkey || ',' || n_name || ',' || n_regionkey AS value FROM nation")
def h02(spark, d):
    return edits.csv_lines(t(spark, d, "nation"))


@query("h04_insert_sql", "SELECT 'INSERT INTO \"main\".\"region\" (\"r_regionkey\", \"r_name\") VALUES (' || r_regionkey || ', ''' || replace(r_name, '''', '''''') || ''');' AS value FROM region")
def h04(spark, d):
    return edits.insert_statements(t(spark, d, "region"), "region", "main")


@query("i02_display", "SELECT doc_id, CASE WHEN length(text) > 512 THEN text[1:512] || '…' ELSE text END AS cell FROM documents")
def i02(spark, d):
    return t(spark, d, "documents").select("doc_id", X.display(F.col("text")).alias("cell"))


@query("i03_affinity", "SELECT * FROM (VALUES ('INTEGER', 'INTEGER'), ('varchar(20)', 'TEXT'), ('BLOB', 'BLOB'), ('', 'BLOB'), ('DOUBLE', 'REAL'), ('DATE', 'NUMERIC'), ('FLOATING POINT', 'INTEGER')) v(declared, affinity)")
def i03(spark, d):
    names = spark.createDataFrame([(x,) for x in ("INTEGER", "varchar(20)", "BLOB", "", "DOUBLE", "DATE", "FLOATING POINT")], "declared string")
    return names.select("declared", X.affinity(F.col("declared")).alias("affinity"))


@query("i06_byte_size", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.0f B', CAST(n_chars AS DOUBLE)) ELSE printf('%.1f KB', floor(n_chars / 1024 * 10 + 0.5) / 10) END AS size FROM documents")
def i06(spark, d):
    return t(spark, d, "documents").select("doc_id", X.byte_size(F.col("n_chars")).alias("size"))


@query("i07_type_family", "SELECT * FROM (VALUES ('int', 'int'), ('bigint', 'int'), ('double', 'float'), ('string', 'text'), ('timestamp_ntz', 'datetime'), ('array<float>', 'array')) v(type, family)")
def i07(spark, d):
    cols = catalog.columns({n: t(spark, d, n) for n in catalog.TABLES})
    return cols.select("type", X.type_family(F.col("type")).alias("family")).distinct()


@query("d21_compact_types", "SELECT * FROM (VALUES ('BIGINT', 'int'), ('character varying(20)', 'text'), ('timestamp with time zone', 'timestamptz'), ('timestamp without time zone', 'timestamp'), ('double precision', 'float'), ('numeric(10,2)', 'numeric'), ('boolean', 'bool'), ('my   type', 'my type'), ('', '')) v(declared, short)")
def d21(spark, d):
    names = ["BIGINT", "character varying(20)", "timestamp with time zone", "timestamp without time zone", "double precision", "numeric(10,2)", "boolean", "my   type", ""]
    return spark.createDataFrame([(x,) for x in names], "declared string").select("declared", X.compact_type(F.col("declared")).alias("short"))


@query("i01_storage_class", "SELECT event_id, CASE WHEN value IS NULL THEN 'NULL' WHEN value = floor(value) THEN 'INTEGER' ELSE 'REAL' END AS of_value, CASE WHEN props IS NULL THEN 'NULL' ELSE 'TEXT' END AS of_props, 'INTEGER' AS of_id FROM events")
def i01(spark, d):
    return t(spark, d, "events").select("event_id", X.storage_class("double", F.col("value")).alias("of_value"), X.storage_class("string", F.col("props")).alias("of_props"), X.storage_class("bigint", F.col("event_id")).alias("of_id"))


@query("i05_same_value", "SELECT a.event_id, a.props IS NOT DISTINCT FROM b.props AS same FROM events a LEFT JOIN events b ON b.event_id = a.event_id + 1")
def i05(spark, d):
    e = t(spark, d, "events").select("event_id", "props")
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("props").alias("next"))
    return e.join(after, "event_id", "left").select("event_id", X.same_value(F.col("props"), F.col("next")).alias("same"))


@query("i13_clip", "SELECT event_id, props FROM (SELECT event_id, props, row_number() OVER (ORDER BY event_id) AS p, sum(length(props)) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT event_id, props FROM events ORDER BY event_id LIMIT 50)) WHERE s <= 300")
def i13(spark, d):
    e = t(spark, d, "events").select("event_id", "props", F.length("props").alias("size"), F.lit(0).alias("all")).orderBy("event_id").limit(50)
    return usage.within_bytes(e, "all", [F.col("event_id")], "size", 50, 300).select("event_id", "props")


@query("e07_query_shape", "SELECT 'select * from orders where o_orderkey=? and o_orderstatus in(?)' AS shape, count(*) AS n FROM orders")
def e07(spark, d):
    sql = F.concat(F.lit("SELECT *  FROM orders WHERE o_orderkey = "), F.col("o_orderkey").cast("string"), F.lit(" AND o_orderstatus IN ('"), F.col("o_orderstatus"), F.lit("', 'it''s', :p);"))
    return t(spark, d, "orders").groupBy(X.query_shape(sql).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("e11_same_key", "SELECT item_id, md5(lower(trim(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), ';+$', '')))) AS k FROM benchmark")
def e11(spark, d):
    return t(spark, d, "benchmark").select("item_id", F.md5(X.same_key(F.col("text"))).alias("k"))


@query("j02_answer_fold", "SELECT conv_id AS stream, string_agg(text, '' ORDER BY turn) AS text, true AS finished FROM conversations GROUP BY conv_id")
def j02(spark, d):
    c = t(spark, d, "conversations")
    event = F.concat(F.lit("event: x\r\ndata: "), F.to_json(F.struct(F.col("text").alias("delta"))), F.lit("\r\n\r\n"))
    chunks = c.select(F.col("conv_id").alias("stream"), F.col("turn").alias("seq"), event.alias("chunk"))
    ends = c.groupBy("conv_id").agg(F.max("turn").alias("m")).select(F.col("conv_id").alias("stream"), (F.col("m") + 1).alias("seq"), F.lit('data: {"done": true}\n\ndata: {"de').alias("chunk"))
    return answers.folded(answers.framed(chunks.unionByName(ends)))


@query("j07_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def j07(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return answers.windowed_counts(e).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("j05_held_back", "SELECT conv_id || ':' || turn AS stream, md5(coalesce(text, '') || ' name-' || conv_id || ':' || turn || ' ' || coalesce(text, '')) AS digest, CAST(0 AS BIGINT) AS cut, true AS finished FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL")
def j05(spark, d):
    """Each turn as a stream of its own: its text, a marker and its text again, in three events cut at any place, the second
    within the marker; their bytes in chunks that come out of order in three batches. No piece ends within a marker, and
    all pieces, restored one by one, make the text."""
    c = t(spark, d, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    rows = c.select(F.concat_ws(":", "conv_id", "turn").alias("stream"), F.coalesce("text", F.lit("")).alias("said"))
    rows = rows.withColumn("id", F.substring(F.sha2("stream", 256), 1, 24))
    whole = F.concat("said", F.lit(" [[pii:PERSON:"), "id", F.lit("]] "), "said")
    cuts = [F.lit(1), F.floor(F.length("said") / 3) + 1, F.length("said") + 3 + F.pmod(F.xxhash64("stream"), F.lit(40)), F.lit(1 << 30)]
    event = lambda i: F.concat(F.lit("event: x\r\ndata: "), F.to_json(F.struct(F.substr("whole", cuts[i].cast("int"), (cuts[i + 1] - cuts[i]).cast("int")).alias("delta"))), F.lit("\r\n\r\n"))
    rows = rows.withColumn("whole", whole).withColumn("body", F.concat(*[event(i) for i in range(3)], F.lit('data: {"done": true}\n\nrest')))
    size = (F.pmod(F.xxhash64("stream", F.lit(1)), F.lit(200)) + 60).cast("int")
    chunks = rows.withColumn("size", size).withColumn("n", F.ceil(F.length("body") / F.col("size")).cast("int"))
    chunks = chunks.select("stream", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("seq"), "n", "size", "body")
    chunks = chunks.select("stream", F.col("seq").cast("long").alias("seq"), F.substr("body", F.col("seq") * F.col("size") + 1, F.col("size")).alias("chunk"), F.least(F.lit(2), F.floor((3 * F.col("seq") + F.pmod(F.xxhash64("stream", "seq"), F.lit(2))) / F.col("n"))).alias("batch"))
    folder, schema = scratch(spark, "answers"), "stream string, seq long, chunk string"
    for i in range(3):
        chunks.where(F.col("batch") == i).drop("batch").repartition(8).write.mode("append").parquet(f"{folder}/chunks")
    found = stateful.streamed(folder, schema, f"{folder}/chunks", spark, files=8).withColumn("piece", F.concat_ws("#", "stream", "place"))
    vault = rows.select(F.lit("PERSON_NAME").alias("identity"), F.concat(F.lit("name-"), "stream").alias("value"), F.col("id").alias("pseudonym"))
    back = protect.restored(found, vault, "piece").groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("p"), F.count_if(F.col("text").rlike(r"\[\[pii(:[A-Z]*(:[0-9a-f]*)?)?$")).alias("cut"), F.bool_or("finished").alias("finished"))
    return back.select("stream", F.md5(F.array_join(F.transform("p", lambda x: x["text"]), "")).alias("digest"), "cut", "finished")


# --- damaged markers ---


def marked_customers(spark, d):
    return t(spark, d, "customer").select("c_custkey", "c_name", F.concat(F.lit("[[pii:PERSON:"), F.substring(F.sha2(F.concat(F.lit("k"), F.col("c_custkey").cast("string")), 256), 1, 24), F.lit("]]")).alias("m"))


@query("g39_damaged", "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 AND c_custkey // 3 % 39 = 0 THEN 'Ask #' ELSE 'Ask ' END || c_name || CASE WHEN c_custkey % 3 = 1 AND c_custkey // 3 % 39 = 38 THEN '# now' ELSE ' now' END AS text FROM customer")
def g39(spark, d):
    """A marker for each customer, with a letter that is missing, changed or too many, at each place in turn: all are read."""
    rows = marked_customers(spark, d)
    at, kind = F.floor(F.col("c_custkey") / 3) % 39, F.col("c_custkey") % 3
    bent = F.concat(F.substr("m", F.lit(1), at.cast("int")), F.when(kind > 0, "#").otherwise(""), F.substr("m", (at + F.when(kind == 2, 1).otherwise(2)).cast("int")))
    texts = rows.select("c_custkey", F.concat(F.lit("Ask "), bent, F.lit(" now")).alias("text"))
    vault = rows.select(F.lit("PERSON_NAME").alias("identity"), F.col("c_name").alias("value"), F.substring("m", 14, 24).alias("pseudonym"))
    return protect.restored(markers.mended(texts, vault, "c_custkey"), vault, "c_custkey")


@query("g40_safe_slice", "WITH c AS (SELECT c_custkey, c_name, '[[pii:PERSON:' || sha256('k' || c_custkey)[1:24] || ']]' AS m, c_custkey % 50 AS n FROM customer), x AS (SELECT *, m || c_name || m AS s, length(c_name) AS l FROM c) SELECT c_custkey, s[1:CASE WHEN n > 0 AND n < 39 THEN 0 WHEN n > 39 + l AND n < 78 + l THEN 39 + l ELSE n END] AS text FROM x")
def g40(spark, d):
    rows = marked_customers(spark, d)
    return rows.select("c_custkey", markers.safe_slice(F.concat("m", "c_name", "m"), (F.col("c_custkey") % 50).cast("int")).alias("text"))


@query("g23_clipped", "WITH c AS (SELECT c_custkey, c_custkey % 40 AS s, length(c_name) AS l FROM customer), x AS (SELECT *, s + 12 AS e FROM c) SELECT c_custkey, s AS \"start\", CASE WHEN e <= l + 1 THEN e ELSE l END AS \"end\" FROM x WHERE s < l OR s = l AND e <= l + 1")
def g23(spark, d):
    """A span of 12 characters somewhere in a name, a space and a marker."""
    rows = marked_customers(spark, d)
    spans = F.array(F.struct((F.col("c_custkey") % 40).cast("int").alias("start"), (F.col("c_custkey") % 40 + 12).cast("int").alias("end")))
    return rows.select("c_custkey", F.explode(markers.clipped(spans, F.concat("c_name", F.lit(" "), "m"))).alias("s")).select("c_custkey", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


# --- folds of a log that can be undone ---


FOLD_SQL = """
WITH e AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, event_type AS value, event_id % 4 AS rank, CASE WHEN event_id % 7 = 3 THEN 'undo' WHEN event_id % 23 = 5 THEN 'forget' ELSE 'learn' END AS kind,
  CASE WHEN event_id % 7 = 3 THEN CASE WHEN event_id % 49 = 10 THEN event_id - 7 ELSE event_id - 1 END END AS target FROM events),
u AS (SELECT * FROM e WHERE kind = 'undo'), live AS (SELECT * FROM u WHERE seq NOT IN (SELECT target FROM u)),
s AS (SELECT * FROM e WHERE kind <> 'undo' AND key IS NOT NULL AND seq NOT IN (SELECT target FROM live)),
f AS (SELECT key, max(seq) AS upto FROM s WHERE kind = 'forget' GROUP BY key),
v AS (SELECT key, value, max(rank * 1000000000000 + seq) AS top, count(*) AS n FROM s LEFT JOIN f USING (key) WHERE kind = 'learn' AND value IS NOT NULL AND (upto IS NULL OR seq > upto) GROUP BY key, value),
"""


def event_log(spark, d):
    """Users learn event types; each seventh event is undone by the next, some of these undos are undone again, and some events make a user forget."""
    i = F.col("event_id")
    undo, redo = i % 7 == 3, i % 49 == 10
    kind = F.when(undo, "undo").when(i % 23 == 5, "forget").otherwise("learn")
    target = F.when(undo, F.when(redo, i - 7).otherwise(i - 1))
    return folds.sanitised(t(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), i.alias("seq"), kind.alias("kind"), F.col("event_type").alias("value"), (i % 4).cast("int").alias("rank"), target.alias("target")))


@query("f13_folds", FOLD_SQL + "r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY top DESC) AS i FROM v) SELECT key, max(CASE WHEN i = 1 THEN value END) AS value, CAST(max(CASE WHEN i = 1 THEN top // 1000000000000 END) AS INTEGER) AS rank, max(CASE WHEN i = 1 THEN top % 1000000000000 END) AS seq, max(CASE WHEN i = 1 THEN n END) AS uses, coalesce(string_agg(CASE WHEN i > 1 AND i <= 6 THEN value END, ' ' ORDER BY i), '') AS replaced FROM r GROUP BY key")
def f13(spark, d):
    return folds.state(event_log(spark, d)).withColumn("replaced", F.array_join("replaced", " "))


@query("f10_domains", FOLD_SQL + "m AS (SELECT s.key, list_sort(list(DISTINCT 't' || seq % 5)) AS tables FROM s LEFT JOIN f USING (key) WHERE kind = 'learn' AND value IS NOT NULL AND (upto IS NULL OR seq > upto) GROUP BY s.key) SELECT v.key AS path, arg_max(value, top) AS description, CAST(max(top) // 1000000000000 AS INTEGER) AS rank, array_to_string(any_value(tables), ' ') AS tables FROM v JOIN m USING (key) GROUP BY v.key")
def f10(spark, d):
    members = t(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string")).alias("table"))
    return folds.domains(event_log(spark, d), members.where("key IS NOT NULL")).withColumn("tables", F.array_join("tables", " "))


# --- tables inside texts ---


@query("g16_csv_values", "WITH c AS (SELECT *, 'Hi ' || c_custkey || chr(10) || 'note;full_name;email' || chr(10) AS head, '\"say \"\"hi\"\"; now\";\"' AS a FROM customer), s AS (SELECT c_custkey, length(head) + length(a) AS p, c_name, 'u' || c_custkey || '@example.com' AS m FROM c) SELECT c_custkey, p AS \"start\", p + length(c_name) AS \"end\", 'PERSON_NAME' AS type, c_name AS value FROM s UNION ALL SELECT c_custkey, p + length(c_name) + 3, p + length(c_name) + 3 + length(m), 'EMAIL_ADDRESS', m FROM s")
def g16(spark, d):
    """A table of one row for each customer, whose first field has the delimiter and quotes in quotes."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("Hi "), key, F.lit('\nnote;full_name;email\n"say ""hi""; now";"'), "c_name", F.lit('"; u'), key, F.lit("@example.com \nbye, all\n"))
    out = csvtext.csv_values(t(spark, d, "customer").select("c_custkey", text.alias("text")), "c_custkey")
    return out.withColumns({c: F.col(c).cast("long") for c in ("start", "end")})


# --- samples ---

SHARE_SQL = "(CAST('0x' || sha256('s:' || {})[1:13] AS BIGINT) + 1) / 4503599627370496.0::DOUBLE"


@query("c18_bernoulli", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {SHARE_SQL.format('l_orderkey')} <= 0.05")
def c18(spark, d):
    """All lines of a twentieth of the orders."""
    return sampling.bernoulli(t(spark, d, "lineitem"), "l_orderkey", 0.05, "s").select("l_orderkey", "l_linenumber")


@query("c18_weighted", f"WITH p AS (SELECT o_orderkey, o_totalprice, CAST(o_totalprice AS DOUBLE) / ({SHARE_SQL.format('o_orderkey')}) AS priority FROM orders WHERE o_totalprice > 0), r AS (SELECT *, row_number() OVER (ORDER BY priority DESC, o_orderkey) AS i FROM p) SELECT o_orderkey, round(greatest(CAST(o_totalprice AS DOUBLE), (SELECT coalesce(max(priority), 0) FROM r WHERE i = 501)), 4) AS estimate FROM r WHERE i <= 500")
def c18_weighted(spark, d):
    return sampling.weighted(t(spark, d, "orders"), "o_orderkey", "o_totalprice", 500, "s").select("o_orderkey", F.round("estimate", 4).alias("estimate"))


@query("c18_stratified", f"SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY {SHARE_SQL.format('o_orderkey')}, o_orderkey) <= 20")
def c18_stratified(spark, d):
    return sampling.stratified(t(spark, d, "orders"), "o_orderkey", "o_orderpriority", 20, "s").select("o_orderkey", "o_orderpriority")


# --- vaults ---

VAULT_SQL = "WITH d AS (SELECT DISTINCT c_name AS value, sha256('key' || chr(2) || sha256('key' || chr(1) || 'PERSON_NAME' || chr(0) || c_name))[1:24] AS pseudonym, c_custkey FROM customer)"


def vault_of(spark, d, where="true"):
    return vault.named(t(spark, d, "customer").where(where).select(F.lit("PERSON_NAME").alias("type"), F.col("c_name").alias("value"), (F.col("c_custkey") % 10 != 3).alias("rehydrate")), "key")


@query("g42_merged", VAULT_SQL + " SELECT 'PERSON_NAME' AS identity, value, pseudonym, bool_and(c_custkey % 10 <> 3) AS rehydrate FROM d GROUP BY value, pseudonym")
def g42(spark, d):
    """Three batches of customers that overlap, merged one after the other."""
    parts = [vault_of(spark, d, w) for w in ("c_custkey % 3 = 1", "c_custkey % 2 = 0", "c_custkey % 3 <> 1 OR c_custkey % 5 = 0")]
    return vault.merged(vault.merged(parts[2], parts[0]), parts[1])


@query("g47_sealed_sql", "SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name = (SELECT max(c_name) FROM customer WHERE c_custkey % 10 <> 3) OR c_name LIKE (SELECT min(c_name) FROM customer WHERE c_custkey % 10 <> 3) || '%'")
def g47(spark, d):
    """A statement about two customers, whose names it has as pseudonyms."""
    names = vault_of(spark, d)
    t(spark, d, "orders").createOrReplaceTempView("__g47_orders")
    t(spark, d, "customer").createOrReplaceTempView("__g47_customer")
    ends = names.where("rehydrate").agg(F.max_by("pseudonym", "value").alias("last"), F.min_by("pseudonym", "value").alias("first")).first()
    sql = f"SELECT o_orderkey, o_custkey FROM __g47_orders JOIN __g47_customer ON o_custkey = c_custkey WHERE c_name = '[[pii:PERSON:{ends['last']}]]' OR c_name LIKE '[[pii:PERSON:{ends['first']}]]%'"
    return vault.opened(spark, sql, names)


@query("g50_requests", MARKED_SQL.format(identity="'EMAIL_ADDRESS'", value="'user' || c_custkey || '@example.com'", table="customer") + "SELECT c_custkey, md5('system|' || CASE WHEN c_custkey % 3 = 0 THEN '[[pii:EMAIL:' || pseudonym || ']]' ELSE 'none' END || '|' || CASE WHEN c_custkey % 3 = 1 THEN 'to [[pii:EMAIL:' || pseudonym || ']] now' ELSE 'none' END || '|' || CASE WHEN c_custkey % 3 = 2 THEN 'to [[pii:EMAIL:' || pseudonym || ']].' ELSE 'none' END) AS digest, CAST(NULL AS VARCHAR) AS error FROM customer JOIN p ON value = 'user' || c_custkey || '@example.com'")
def g50(spark, d):
    """A request for each customer, with a mail address in an argument, in a message's part or in its text."""
    mail = F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com"))
    at = lambda i, c: F.when(F.col("c_custkey") % 3 == i, c).otherwise("none")
    part = F.struct(at(1, F.concat(F.lit("to "), mail, F.lit(" now"))).alias("text"), F.create_map(F.lit("x"), at(2, F.concat(F.lit("to "), mail, F.lit(".")))).alias("args"))
    asked = t(spark, d, "customer").select("c_custkey", F.struct(F.lit("system").alias("role"), F.array(part, part).alias("parts"), at(0, mail).alias("to")).alias("body"))
    out = requests.protected_requests(asked, "key", ["body"])[0]
    return out.select("c_custkey", F.md5(F.concat_ws("|", "body.role", "body.to", F.col("body.parts")[1]["text"], F.col("body.parts")[0]["args"]["x"])).alias("digest"), "error")


# --- lineage ---


@query("f18_closure", "WITH RECURSIVE o AS (SELECT o_orderkey AS source, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS target FROM orders WHERE o_orderpriority = '1-URGENT'), l AS (SELECT * FROM o WHERE target IS NOT NULL), c(source, target, steps) AS (SELECT source, target, 1 FROM l UNION ALL SELECT c.source, l.target, steps + 1 FROM c JOIN l ON c.target = l.source) SELECT source, target, CAST(steps AS INTEGER) AS steps FROM c")
def f18(spark, d):
    """Each urgent order is followed by its customer's next one: all later ones, and how many orders on."""
    o = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    links = o.select(F.col("o_orderkey").alias("source"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("target")).where("target IS NOT NULL")
    return lineage.closure(links)


@query("f17_domains", "WITH x AS (SELECT DISTINCT source AS \"table\", lang AS path, 1 AS r, 1 AS depth FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL UNION SELECT DISTINCT source, lang || ' › ' || source, 1, 2 FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL UNION SELECT DISTINCT source, 'all', 2, 1 FROM documents WHERE source IS NOT NULL) SELECT \"table\", CAST(row_number() OVER (PARTITION BY \"table\" ORDER BY r DESC, depth DESC, path) AS INTEGER) AS place, path FROM x")
def f17(spark, d):
    """Sources as tables, in domains by language, by language and source, and in a trusted one of all."""
    docs = t(spark, d, "documents").where("source IS NOT NULL")
    some = docs.where("lang IS NOT NULL")
    path = lambda rows, p, rank: rows.select(p.alias("path"), "source").groupBy("path").agg(F.collect_set("source").alias("tables")).withColumn("rank", F.lit(rank))
    domains = path(some, F.col("lang"), 1).unionByName(path(some, F.concat("lang", F.lit(" › "), "source"), 1)).unionByName(path(docs, F.lit("all"), 2))
    return lineage.domains_of(domains)


# --- knowledge and known values ---


@query("a41_uncached", "SELECT DISTINCT sha1(text) AS key, text FROM documents WHERE sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE doc_id % 2 = 0)")
def a41(spark, d):
    docs = t(spark, d, "documents")
    cache = docs.where("doc_id % 2 = 0").select(F.lit("m").alias("model"), F.sha1("text").alias("key"))
    return knowledge.uncached(docs, cache, "m")


@query("f06_learnt")
def f06(spark, d):
    e = t(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.col("event_type").alias("meaning"), (F.col("event_id") % 4).cast("int").alias("rank"), "ts")
    return knowledge.learnt(e)


@query("f16_outline", "WITH n AS (SELECT DISTINCT lang || '_' || source AS name, lang AS domain FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL), s AS (SELECT *, count(*) OVER (PARTITION BY domain) AS n FROM n) SELECT name, domain FROM s WHERE n >= 2 UNION ALL SELECT 'alone', 'en' WHERE (SELECT count(*) FROM n WHERE domain = 'en') >= 2")
def f16(spark, d):
    """A table for each language and source, and one that is linked to an English one only."""
    names = t(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select(F.concat_ws("_", "lang", "source").alias("name")).distinct()
    english = names.where("name LIKE 'en_%'").agg(F.min("name").alias("to_table"))
    edges = english.select(F.lit("alone").alias("from_table"), F.lit("x").alias("from_column"), "to_table", F.lit("y").alias("to_column"))
    return knowledge.outline(names.unionByName(names.sparkSession.createDataFrame([("alone",)], "name string")), edges)


@query("f21_values", "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment = 'BUILDING'")
def f21(spark, d):
    known = t(spark, d, "customer").select(F.col("c_mktsegment").alias("value")).distinct().withColumns({"column": F.lit("c_mktsegment"), "weight": F.lit(1.0)})
    return knowledge.recalled_values(known, F.lit("How many building customers?")).select("value")


@query("f22_runbook")
def f22(spark, d):
    b = t(spark, d, "benchmark")
    entries = b.select(F.col("item_id").alias("name"), X.tokens(F.col("text")).alias("tokens"), (F.col("item_id") % 5).alias("runs"), (F.col("item_id") % 7).alias("failures"))
    words = b.where("item_id = 1").select(F.explode(F.slice(X.tokens(F.col("text")), 1, 12)).alias("token"))
    return knowledge.recalled_runbook(entries, words).select("name", "hits", F.round("score", 6).alias("score"))


@query("f23_domains", "WITH g AS (SELECT lang AS path, list_sort(list(DISTINCT source)) AS tables FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang), s AS (SELECT lang || '_' AS x, min(source) AS seed FROM documents WHERE lang = 'de' GROUP BY lang), h AS (SELECT path, tables, CASE WHEN path = 'fr' THEN 1 ELSE 0 END AS hit, CASE WHEN list_contains(tables, seed) THEN 1 ELSE 0 END AS holds FROM g LEFT JOIN s ON true) SELECT path, 3 * hit + 2 * holds + 1 AS score, CASE WHEN 3 * hit + 2 * holds + 1 >= 3 THEN array_to_string(tables[1:6], ' ') ELSE '' END AS named FROM h WHERE hit > 0 OR holds > 0 ORDER BY score DESC, path LIMIT 4")
def f23(spark, d):
    docs = t(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    domains = docs.groupBy(F.col("lang").alias("path")).agg(F.sort_array(F.collect_set("source")).alias("tables")).select("path", "tables", X.tokens(F.col("path")).alias("tokens"), F.lit(False).alias("structural"))
    seeds = docs.where("lang = 'de'").agg(F.min("source").alias("table"))
    return knowledge.recalled_domains(domains, F.array(F.lit("fr")), seeds).select("path", "score", F.array_join("named", " ").alias("named"))


@query("f28_sections", "SELECT 'head' || chr(10) || string_agg(r_name, chr(10) ORDER BY r_regionkey) AS text FROM region WHERE r_regionkey IN (SELECT r_regionkey FROM region)")
def f28(spark, d):
    """Each region's name fits; a long part among them does not, and is left out whole."""
    parts = t(spark, d, "region").select((F.col("r_regionkey") * 2).cast("int").alias("place"), F.col("r_name").alias("text"))
    long = parts.where("place = 2").select(F.lit(3).alias("place"), F.repeat(F.lit("x"), 6000).alias("text"))
    return knowledge.sections(parts.unionByName(long), "head")


@query("g17_known_values", "WITH v AS (SELECT DISTINCT lang AS value FROM documents), w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM documents) SELECT doc_id, w AS value, 'STATE' AS type, count(*) AS n FROM w WHERE w IN ('the', 'auch', 'pour') GROUP BY doc_id, w")
def g17(spark, d):
    known = spark.createDataFrame([("the", "STATE"), ("auch", "STATE"), ("pour", "STATE"), ("de", "STATE")], "value string, type string")
    return values.known_values(t(spark, d, "documents").select("doc_id", "text"), known, "doc_id")


@query("g19_column_type", "SELECT 'URL' AS type, CAST(20 AS BIGINT) AS votes")
def g19(spark, d):
    return values.inferred_column(t(spark, d, "pages"), "url")


@query("g63_greedy_spans")
def g63(spark, d):
    e = t(spark, d, "events").select("user_id", F.struct((F.col("event_id") % 50).cast("int").alias("start"), (F.col("event_id") % 50 + F.col("event_id") % 7 + 1).cast("int").alias("end"), (F.col("value") / 100).alias("score"), F.col("event_type").alias("label")).alias("s"))
    return e.groupBy("user_id").agg(F.size(values.greedy(F.collect_list("s"), 0.1)).alias("n"))
