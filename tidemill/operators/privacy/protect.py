"""Resolving overlaps and replacing what was found."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.validators import masked
from tidemill.operators.privacy import policy
from tidemill.operators.privacy.detect import detected
from tidemill.operators.stored import among, apart, are_few, stored

#: Sources by trust, and actions by severity.
SOURCE_RANK = {"validated": 5, "schema": 4, "deterministic": 3, "custom": 2, "semantic": 1, "semantic-unknown": 0}
SEVERITY = {"preserve": 0, "generalize": 1, "pseudonymize": 2, "mask": 3, "redact": 4}
LEAST_KNOWN = 3
MARKER = r"\[\[(pii|redacted|masked):[A-Z_]+(?::[0-9A-Za-z]+)?\]\]"


def _known(values: dict, c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def merged(rows: DataFrame, key: list[str], touching: bool = False) -> DataFrame:
    """Adds cluster: intervals (start, end; half open) of a key that overlap are one; touching ones only if wanted."""
    w = Window.partitionBy(*key).orderBy("start", F.desc("end"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = reach.isNull() | (F.col("start") > reach if touching else F.col("start") >= reach)
    return rows.withColumn("fresh", fresh.cast("int")).withColumn("cluster", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def resolved(spans: DataFrame, key: list[str], least: float = policy.LEAST_CONFIDENCE) -> DataFrame:
    """One row for each cluster of spans: its extent, and its primary by source, length, confidence, severity, start, detector and type."""
    action = policy.looked_up(F.col("type"), 2)
    rows = merged(spans.where(F.col("confidence") >= least), key)
    order = F.struct((-_known(SOURCE_RANK, F.col("source"))).alias("o1"), (F.col("start") - F.col("end")).alias("o2"), (-F.col("confidence")).alias("o3"), (-_known(SEVERITY, action)).alias("o4"), F.col("start").alias("o5"), F.col("detector").alias("o6"), F.col("type").alias("o7"))
    # what withholds most wins over what would let a part be seen
    severest = F.max(_known(SEVERITY, action))
    out = rows.groupBy(*key, "cluster").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(F.struct("type", "detector", "confidence", "source"), order).alias("p"), severest.alias("severity"), F.count(F.lit(1)).alias("members"))
    own = policy.looked_up(F.col("p.type"), 2)
    decided = F.when(F.col("severity") == SEVERITY["redact"], "redact").otherwise(own)
    return out.select(*key, "start", "end", "p.*", "members", decided.alias("action"))


def exploded(df: DataFrame, key: list[str], spans: str = "spans") -> DataFrame:
    return df.select(*key, F.explode(spans).alias("s")).select(*key, "s.*")


def marker(type_: Column, action: Column, value: Column, pseudonym: Column) -> Column:
    tag = policy.looked_up(type_, 1)
    return (
        F.when(action == "preserve", value)
        .when(action == "redact", F.concat(F.lit("[[redacted:"), tag, F.lit("]]")))
        .when(action == "mask", F.concat(F.lit("[[masked:"), tag, F.when(masked(value) != "", F.concat(F.lit(":"), masked(value))).otherwise(""), F.lit("]]")))
        .otherwise(F.concat(F.lit("[[pii:"), tag, F.lit(":"), pseudonym, F.lit("]]")))
    )


def replaced(text: Column, spans: Column) -> Column:
    """Text with spans (start, end, new), sorted and apart, replaced from left to right."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["new"]).alias("out"), s["end"].alias("at"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))


ROUNDS = 4


def known_spans(df: DataFrame, values: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Where values (value, type) that are known stand in texts, as whole words: key and the columns of a span. A text
    meets only the values of which it has two words, one after the other (or the one of those that have no second): those
    that the fewest other values have, so that values which begin alike don't meet each other's texts. Values without a word
    are searched in no text. Words and texts that meet nothing are not shuffled."""
    words = lambda c: F.regexp_extract_all(c, F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1))
    pairs = F.zip_with("w", F.slice("w", 2, F.size("w") + 1), lambda a, b: F.xxhash64(a, b))
    some = values.where(F.length("value") >= LEAST_KNOWN).select("value", "type").distinct().withColumn("w", words(F.col("value"))).where(F.size("w") > 0)
    some = some.select("value", "type", F.posexplode(F.slice(pairs, F.lit(1), F.greatest(F.size("w") - 1, F.lit(1)))).alias("at", "met"))
    shared = some.groupBy("met").agg(F.count(F.lit(1)).alias("n"))
    some = stored(some.join(apart(shared), "met").groupBy("value", "type").agg(F.min_by("met", F.struct("n", "at")).alias("met")), "protect-known")
    of = df.select(key, words(F.col(text)).alias("w"))
    hits = of.select(key, F.explode(F.concat(F.transform("w", lambda a: F.xxhash64(a, F.lit(None).cast("string"))), pairs)).alias("met"))
    hits = among(hits, some.select("met").distinct(), "met")
    known = stored(hits.distinct().join(apart(some), "met").groupBy(key).agg(F.collect_set(F.struct("value", "type")).alias("known")), "protect-met")
    met = among(df.select(key, F.col(text).alias("__text")), known.select(key), key).join(apart(known), key)
    names = ["start", "end", "type", "confidence", "source", "detector", "validated"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.bool_()]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (known, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for k in known:
                    # a value's edge must not lie inside a word
                    for m in re.finditer(r"(?<!\w)" + re.escape(k["value"]) + r"(?!\w)", t):
                        at.append(i)
                        rows.append((m.start(), m.end(), k["type"], 0.99, "validated", "known-value", True))
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=[key, *names])

    kind = dict(df.dtypes)[key]
    return met.select(key, "known", "__text").mapInArrow(tasks, f"`{key}` {kind}, start int, end int, type string, confidence double, source string, detector string, validated boolean")


def valued(spans: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """Spans with the value they cover."""
    return among(df.select(key, text), spans.select(key).distinct(), key).join(apart(spans), key).select(*spans.columns, F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")).alias("value"))


def changed(rows: DataFrame, changes: DataFrame, key: str, text: str, new: Column) -> DataFrame:
    """rows, with the text that `new` makes of what changes (__key and more; stored) has for their key, null or not. While
    changes are few, texts that stay are not shuffled."""
    names = [F.col(f"`{c}`") for c in rows.columns]
    same = F.col(key).eqNullSafe(F.col("__key"))
    keys = changes.select("__key")
    if not are_few(keys):
        return rows.join(apart(changes), same, "left").withColumn(text, F.when(F.col("__key").isNull() & F.col(key).isNotNull(), F.col(text)).otherwise(F.coalesce(new, F.col(text)))).select(*names)
    some = rows.join(F.broadcast(keys), same, "left_semi").join(apart(changes), same).withColumn(text, new).select(*names)
    return some.unionByName(rows.join(F.broadcast(keys), same, "left_anti").select(*names))


#: The column that names a row while its texts are protected: keys may be null or repeat.
ROW = "__row"


def numbered(df: DataFrame) -> DataFrame:
    """df, stored, with a number for each row."""
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()), "protect-rows")


def protected(df: DataFrame, key: str, secret: str, text: str = "text", actions: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(df with its text protected, the vault: identity, value, pseudonym).

    Texts travel together: a value found in one is protected in all. Rounds go on until all places of the found values
    are known, and fail after ROUNDS. actions: what is done, by the column `type`, in place of the policy's. Every row is
    protected by itself and stays, whatever its key is: null, repeated, or on rows that are equal. Columns keep their order.
    """
    if key not in df.columns:
        raise ValueError(f"no column {key}")
    out, vault = _protected(numbered(df), secret, text, actions)
    return out.drop(ROW), vault


def _protected(rows: DataFrame, secret: str, text: str, actions: Column | None = None, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """rows have a ROW each. found: spans by ROW, if they have been looked for before."""
    key = ROW
    found = stored(exploded(detected(rows.select(key, text), text), [key]), "protect-found") if found is None else found
    for _ in range(ROUNDS):
        spans = resolved(found, [key])
        spans = spans if actions is None else spans.withColumn("action", actions)
        spans = stored(spans.where("action <> 'preserve'"), "protect-spans")
        values = stored(valued(spans, rows, key, text), "protect-values")
        # a place that lies in a longer one is protected with it
        covers = values.select(F.col(key).alias("__key"), F.col("start").alias("s"), F.col("end").alias("e"))
        more = known_spans(rows, values.select("value", "type"), key, text)
        more = stored(more.join(apart(covers), (F.col(key) == F.col("__key")) & (F.col("s") <= F.col("start")) & (F.col("end") <= F.col("e")), "left_anti"), "protect-more")
        if more.limit(1).count() == 0:
            break
        found = found.unionByName(more)
    else:
        raise RuntimeError(f"texts still change after {ROUNDS} rounds")
    vault = policy.pseudonyms(values.where("action = 'pseudonymize'").select("type", "value"), secret)
    identity = F.coalesce(_known(policy.SAME_IDENTITY, F.col("type")), F.col("type"))
    named = values.withColumn("identity", identity).join(apart(vault), ["identity", "value"], "left")
    changes = named.select(key, F.struct("start", "end", marker(F.col("type"), F.col("action"), F.col("value"), F.col("pseudonym")).alias("new")).alias("c")).groupBy(key).agg(F.sort_array(F.collect_list("c")).alias("__changes"))
    changes = stored(changes.withColumnRenamed(key, "__key"), "protect-changes")
    return changed(rows, changes, key, text, replaced(F.col(text), F.col("__changes"))), vault


def protected_columns(df: DataFrame, key: str, secret: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(df with columns protected, the vault). A column whose name, or else whose values, tell its type is protected value
    by value, as a whole; other ones are read as prose. Types that the policy preserves stay. All rows stay, whatever their
    keys are, and columns keep their order; protected ones are strings."""
    if key not in df.columns:
        raise ValueError(f"no column {key}")
    vaults, order = [], df.columns
    df = numbered(df)
    for c in columns:
        kind = _class_of(df, c)
        text = F.col(c).cast("string")
        if kind is None:
            part, vault = _protected(df.select(ROW, text.alias(c)), secret, c)
            df = df.drop(c).join(part, ROW)
            vaults.append(vault)
            continue
        action = next(r[2] for r in policy.ROWS if r[0] == kind)
        if action == "preserve":
            continue
        values = df.select(F.lit(kind).alias("type"), text.alias("value")).where("value IS NOT NULL AND value <> ''")
        vault = policy.pseudonyms(values, secret) if action == "pseudonymize" else None
        named = df.withColumn(c, text)
        pseudonym = F.lit(None).cast("string")
        if vault is not None:
            named = named.join(vault.select(F.col("value").alias(c), F.col("pseudonym").alias("__pseudonym")), c, "left")
            pseudonym = F.col("__pseudonym")
            vaults.append(vault)
        new = marker(F.lit(kind), F.lit(action), F.col(c), pseudonym)
        df = named.withColumn(c, F.when(F.col(c).isNull() | (F.col(c) == ""), F.col(c)).otherwise(new)).drop("__pseudonym")
    none = df.sparkSession.createDataFrame([], "identity string, value string, pseudonym string")
    return df.select(*[F.col(f"`{c}`") for c in order]), reduce(DataFrame.unionByName, vaults, none).distinct()


def _class_of(df: DataFrame, column: str) -> str | None:
    from tidemill.operators.privacy.values import inferred_column, name_class

    return name_class(column) or next((r["type"] for r in inferred_column(df, column).collect()), None)



def verified(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """type, problems: what detectors still find outside markers; values never appear. Kept types don't count."""
    bare = df.select(key, F.regexp_replace(F.col(text), MARKER, " ").alias(text))
    left = exploded(detected(bare, text), [key]).where(policy.looked_up(F.col("type"), 2) != "preserve")
    return left.where(F.col("confidence") >= policy.LEAST_CONFIDENCE).groupBy("type").agg(F.count(F.lit(1)).alias("problems"))


def restored(df: DataFrame, vault: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Texts with their pseudonyms replaced by the vault's values; markers without one stay."""
    marks = df.select(key, F.posexplode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(\[\[pii:[A-Z_]+:[0-9a-f]+\]\])"), F.lit(1)))).alias("i", "m"))
    marks = marks.withColumn("pseudonym", F.regexp_extract("m", r":([0-9a-f]+)\]\]", 1)).withColumn("tag", F.regexp_extract("m", r"pii:([A-Z_]+):", 1))
    known = vault.withColumn("tag", policy.looked_up(F.col("identity"), 1))
    # rows that share a key, or have none, share their markers: a marker that a text lacks changes nothing there
    pairs = marks.join(apart(known), ["pseudonym", "tag"]).groupBy(F.col(key).alias("__key")).agg(F.collect_set(F.struct("m", "value")).alias("__pairs"))
    return changed(df, stored(pairs, "restore-pairs"), key, text, F.aggregate("__pairs", F.col(text), lambda a, p: F.replace(a, p["m"], p["value"])))


def report(spans: DataFrame) -> DataFrame:
    """Distinct values (type, value, action) by type."""
    return spans.groupBy("type", "action").agg(F.countDistinct("value").alias("values"))
