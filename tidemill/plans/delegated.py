"""SQL that the engine hands on as it is: Spark SQL, with DuckDB's text where the dialects differ."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.plans.catalog import TABLES

#: name -> (SQL for both,) or (Spark's SQL, DuckDB's SQL)
SQL: dict[str, tuple[str, ...]] = {
    "b01_join4": ("SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",),
    "b02_left": ("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",),
    "b03_unnest_parallel": (
        "SELECT n_nationkey, pos + 1 AS place, x.a AS part, x.b AS size FROM nation LATERAL VIEW posexplode(arrays_zip(split(n_name, 'A'), transform(split(n_name, 'A'), s -> length(s)))) t AS pos, y LATERAL VIEW explode(array(named_struct('a', y['0'], 'b', y['1']))) u AS x",
        "SELECT n_nationkey, i AS place, list_extract(p, i) AS part, length(list_extract(p, i)) AS size FROM (SELECT n_nationkey, string_split(n_name, 'A') AS p FROM nation), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)",
    ),
    "b04_scalar_subquery": ("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer",),
    "b05_exists": ("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 49)",),
    "b06_not_in": ("SELECT p_partkey, p_name FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12') AND p_type NOT LIKE '%STEEL%'",),
    "b07_in_list": ("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F', 'O')",),
    "b08_any_array": ("SELECT n_name FROM nation WHERE array_contains(array(0, 3, 5), n_nationkey)", "SELECT n_name FROM nation WHERE n_nationkey = ANY([0, 3, 5])"),
    "b09_ilike": ("SELECT p_partkey FROM part WHERE p_name ILIKE '%a_e%'",),
    "b10_group_count": ("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",),
    "b11_filter_agg": ("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS large, count(*) AS n FROM lineitem GROUP BY l_returnflag",),
    "b12_ordered_collect": (
        "SELECT n_regionkey, array_join(transform(array_sort(collect_list(struct(n_nationkey, n_name))), x -> x.n_name), ',') AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
    ),
    "b13_order_summary": ("SELECT c_custkey, c_name, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name",),
    "b14_order_expression": ("SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal < 0, s_nationkey DESC, s_suppkey LIMIT 20",),
    "b15_top_k": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 26",),
    "b16_distinct_limit": ("SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_mktsegment LIMIT 21",),
    "b17_case": ("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS kind FROM part",),
    "b18_coalesce": ("SELECT d.doc_id, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",),
    "b19_casts": ("SELECT CAST(o_orderkey AS STRING) AS k, CAST(o_totalprice AS BIGINT) - CAST(o_totalprice AS BIGINT) AS z, CAST(o_orderdate AS DATE) AS d FROM orders", "SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(0 AS BIGINT) AS z, CAST(o_orderdate AS DATE) AS d FROM orders"),
    "b20_row_compare": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey > 100 OR (l_orderkey = 100 AND l_linenumber > 2) ORDER BY l_orderkey, l_linenumber LIMIT 50",),
    "b21_null_safe": ("SELECT count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NOT DISTINCT FROM NULL",),
    "b22_series": ("SELECT a.id * 10 + b.id AS v FROM range(5) a JOIN range(4) b ON a.id >= b.id", "SELECT CAST(a.range * 10 + b.range AS BIGINT) AS v FROM range(5) a JOIN range(4) b ON a.range >= b.range"),
    "c01_full_using": ("SELECT doc_id, d.lang, l.quality FROM documents d FULL JOIN labels l USING (doc_id)",),
    "c01_right": ("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0",),
    "c02_anti": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",),
    "c02_semi_in": ("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",),
    "c03_asof": (
        "WITH e AS (SELECT event_id, user_id, ts, event_type FROM events) SELECT p.event_id, max_by(c.event_id, struct(c.ts, c.event_id)) AS before FROM e p JOIN e c ON p.user_id = c.user_id AND c.event_type = 'click' AND c.ts < p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id",
        "WITH e AS (SELECT event_id, user_id, ts, event_type FROM events) SELECT p.event_id, arg_max(c.event_id, (c.ts, c.event_id)) AS before FROM e p JOIN e c ON p.user_id = c.user_id AND c.event_type = 'click' AND c.ts < p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id",
    ),
    "c03_range_join": ("SELECT p_partkey, l_orderkey, l_linenumber FROM part JOIN lineitem ON l_partkey = p_partkey AND l_extendedprice BETWEEN p_retailprice * 10 AND p_retailprice * 11",),
    "c04_lateral": ("SELECT n_name, t.most FROM nation, LATERAL (SELECT max(c_acctbal) AS most FROM customer WHERE c_nationkey = n_nationkey) t",),
    "c05_aggregates": ("SELECT l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_discount), 6) AS mean, min(l_shipdate) AS first, max(l_quantity) AS most FROM lineitem GROUP BY l_linestatus",),
    "c06_distinct_agg": ("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus",),
    "c07_having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10",),
    "c08_rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",),
    "c08_cube": ("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)",),
    "c08_grouping_sets": ("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())",),
    "c09_rank": ("SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer",),
    "c09_frame": ("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders",),
    "c10_nulls_last": ("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS LAST, d.doc_id LIMIT 40 OFFSET 10",),
    "c11_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",),
    "c11_intersect": ("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier",),
    "c11_except": ("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45",),
    "c12_recursive": ("WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 12) SELECT n, f FROM t",),
    "c12_cte": ("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), m AS (SELECT avg(s) AS a FROM big) SELECT o_custkey FROM big, m WHERE s > 2 * a",),
    "c13_predicates": ("SELECT p_partkey FROM part WHERE (p_size BETWEEN 5 AND 9 OR p_name LIKE 'a%') AND p_type IS NOT NULL AND NOT p_brand = 'Brand#33'",),
    "c13_regexp": ("SELECT p_partkey FROM part WHERE p_name RLIKE '^[a-m].*e'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m].*e')"),
    "c14_scalars": ("SELECT n_nationkey, upper(n_name) AS u, length(n_name) AS len, substr(n_name, 2, 3) AS s, nullif(n_regionkey, 0) AS r, abs(n_nationkey - 10) AS a, trim(concat(' ', n_name, ' ')) AS t FROM nation",),
    "c15_dates": (
        "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, count(*) AS n, CAST(max(date_add(CAST(o_orderdate AS DATE), 30)) AS DATE) AS later FROM orders GROUP BY date_trunc('month', o_orderdate)",
        "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, count(*) AS n, CAST(max(CAST(o_orderdate AS DATE) + 30) AS DATE) AS later FROM orders GROUP BY date_trunc('month', o_orderdate)",
    ),
    "c16_json": ("SELECT event_type, count(*) AS n, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type"),
    "c17_arrays": ("SELECT vec_id, size(embedding) AS n, array_max(transform(embedding, x -> CAST(x AS DOUBLE))) AS most FROM embeddings", "SELECT vec_id, len(embedding) AS n, CAST(list_max(embedding) AS DOUBLE) AS most FROM embeddings"),
    "c22_top_values": ("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3",),
}


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = SQL[name][0]
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(text)

    return run
