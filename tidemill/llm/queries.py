"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import chat, lloyd, mixing, ngram_join, ogg, packing, paragraph_dedup, quality, records, resampling, suffix_dedup, toxicity, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_packing": packing.op2_packing,
    "op3_mixing": mixing.op3_mixing,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_paragraph_dedup": paragraph_dedup.op5_paragraph_dedup,
    "op6_chat": chat.op6_chat,
    "op7_warc": warc.op7_warc,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_quality": quality.op9_quality,
    "op10_ogg": ogg.op10_ogg,
    "op11_dual_tree": lloyd.op11_dual_tree,
    "op12_records": records.op12_records,
    "op13_resampling": resampling.op13_resampling,
    "pipeline": pipeline,
}

#: Every string of 100 bytes as hex digits; those that are not the first of their kind are covered.
OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS p FROM d WHERE length(x) >= 200)),
c AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS i FROM w) WHERE i > 1),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER o + 100 THEN 0 ELSE 1 END AS fresh FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS r FROM g),
r AS (SELECT doc_id, r, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, r),
k AS (SELECT d.doc_id, r.a, r.b, substr(x, 2 * coalesce(lag(b) OVER o, 0) + 1, 2 * (a - coalesce(lag(b) OVER o, 0))) AS part FROM r JOIN d USING (doc_id) WINDOW o AS (PARTITION BY r.doc_id ORDER BY a)),
j AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(part, '' ORDER BY a) AS parts FROM k GROUP BY doc_id)
SELECT d.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(parts, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN j USING (doc_id)
"""

OP8_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM t),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id WHERE r.root < u.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, (SELECT min(root) FROM r WHERE r.doc_id = s.doc_id) AS component_id FROM s
"""

ORACLE_SQL: dict[str, str] = {
    "op4_suffix_dedup": OP4_SQL,
    "op7_warc": warc.OP7_SQL,
    "op8_ngram_join": OP8_SQL,
    "op11_dual_tree": lloyd.OP11_SQL,
    "op13_resampling": resampling.OP13_SQL,
}
