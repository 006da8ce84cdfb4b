"""Values known already, labels in texts, columns by their values, and what was protected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.privacy.detect import NAME_RULES, detected
from tidemill.operators.privacy.protect import exploded

LEAST_LENGTH, SAMPLE, LEAST_VALUES = 3, 20, 3
_CLASSES = [(kind, re.compile("(^|_)(" + "|".join(keys) + ")$")) for kind, keys in NAME_RULES]
_LABELS = (
    re.compile(r"\"(?P<k>[A-Za-z_][\w .-]{1,40})\"\s*:\s*\"(?P<v>(?:[^\"\\]|\\.){1,200})\""),
    re.compile(r"\b(?P<k>[A-Za-z_]\w{1,40})\s*=\s*'(?P<v>(?:[^']|''){1,200})'"),
    re.compile(r"\b(?P<k>[A-Za-z_]\w{1,40})=(?P<v>[^\s'\"&;,=]{1,200})"),
    re.compile(r"^[ \t]*(?P<k>[A-Za-z][\w .-]{1,40}?)[ \t]*:[ \t]+(?P<v>\S[^\n]{0,200}?)[ \t]*$", re.M),
)


def name_class(name: str) -> str | None:
    words = "_".join(w for w in re.split(r"[^A-Za-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()) if w)
    return next((kind for kind, p in _CLASSES if p.search(words)), None)


def labelled(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of values whose label tells what they are: JSON pairs, comparisons, assignments and lines."""
    out = set()
    if ":" not in text and "=" not in text:
        return []
    for p in _LABELS:
        for m in p.finditer(text):
            kind = name_class(m["k"])
            if kind:
                out.add((*m.span("v"), kind))
    return sorted(out)


def labelled_values(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, start, end, type, value of labelled values."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, a, b, kind, t[a:b]) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, b, kind in labelled(t or "")]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], names=[key, "start", "end", "type", "value"])

    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(text).cast("string")).mapInArrow(tasks, f"`{key}` {kind}, start int, end int, type string, value string")


def known_values(df: DataFrame, values: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, value, type, n: how often each known value (value, type) stands in each text, as whole words and as spelt.

    Texts meet values by the value's first word, so only texts with that word are searched for it.
    """
    word = "[\\p{L}\\p{N}_]+"
    some = values.where(F.length("value") >= LEAST_LENGTH).select("value", "type", F.regexp_extract("value", f"({word})", 1).alias("word")).where("word <> ''").distinct()
    words = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"({word})"), F.lit(1)))).alias("word"))
    met = words.join(some, "word").select(key, "value", "type").distinct().join(df.select(key, text), key)
    # a value's edge must not lie inside a word
    quoted = F.concat(F.lit("(?<![\\p{L}\\p{N}_])\\Q"), "value", F.lit("\\E(?![\\p{L}\\p{N}_])"))
    return met.withColumn("n", F.regexp_count(F.col(text), quoted)).where("n > 0").select(key, "value", "type", F.col("n").cast("long").alias("n"))


def inferred_column(df: DataFrame, column: str) -> DataFrame:
    """type, votes of a column by up to SAMPLE distinct values: a value votes for what covers half of it or more; the winner
    needs half of the values, of at least LEAST_VALUES."""
    values = df.select(F.trim(F.col(column).cast("string")).alias("value")).where("value <> ''").distinct().orderBy(F.xxhash64("value")).limit(SAMPLE)
    spans = exploded(detected(values, "value"), ["value"])
    cover = spans.groupBy("value", "type").agg(F.sum(F.col("end") - F.col("start")).alias("chars")).where(2 * F.col("chars") >= F.length(F.regexp_replace("value", "\\s", "")))
    n = values.agg(F.count(F.lit(1)).alias("n"))
    votes = cover.groupBy("type").agg(F.countDistinct("value").alias("votes"))
    return votes.join(F.broadcast(n), (F.col("n") >= LEAST_VALUES) & (2 * F.col("votes") >= F.col("n"))).orderBy(F.desc("votes"), "type").limit(1).select("type", "votes")


def without_identifiers(spans: DataFrame, names: DataFrame) -> DataFrame:
    """Findings (value, ...) that are no table's or column's name (name)."""
    return spans.join(names.select(F.lower("name").alias("__n")).distinct(), F.lower("value") == F.col("__n"), "left_anti")


def greedy(spans: Column, least: float = 0.5) -> Column:
    """Of scored spans (start, end, score, label) the best first, without those that overlap a better one; in text order."""
    best = F.array_sort(F.filter(spans, lambda s: s["score"] > least), lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(0))
    none = F.filter(spans, lambda s: F.lit(False))
    kept = F.aggregate(best, none, lambda acc, s: F.when(F.exists(acc, lambda k: (s["start"] < k["end"]) & (k["start"] < s["end"])), acc).otherwise(F.concat(acc, F.array(s))))
    return F.sort_array(kept)


def markers(text: Column) -> Column:
    """kind and tag of each well-formed marker in a text."""
    whole = F.regexp_extract_all(text, F.lit(r"(\[\[(?:pii|redacted|masked):[A-Z_]+(?::[0-9A-Za-z]+)?\]\])"), F.lit(1))
    return F.transform(whole, lambda m: F.struct(F.regexp_extract(m, r"\[\[(\w+):", 1).alias("kind"), F.regexp_extract(m, r":([A-Z_]+)", 1).alias("tag")))


def legend(values: DataFrame) -> DataFrame:
    """One row for each protected value (type, value, action, doc_id): occurrences, documents, and whether it can be restored."""
    return values.groupBy("type", "value", "action").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("doc_id").alias("documents")).withColumn("restorable", F.col("action") == "pseudonymize")
