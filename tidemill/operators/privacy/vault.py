"""A vault that grows in batches, and statements that speak in pseudonyms.

A pseudonym of a vault is a keyed digest of what it stands for alone, so it depends on no other value: vaults of two batches
are merged by taking both, in any order, and names that were given never change. Values that were withheld (redacted,
masked, generalized) are kept with what was done, so that they are caught in later batches too; they have no pseudonym.
Pseudonyms of a vault that is gone are adopted from a history: they are other names of their values, unless they mean
something else already.

A statement's pseudonyms become parameters: Spark's parser tells where its string literals stand, and each one with a
pseudonym is replaced by a parameter's name. So no value enters a statement's text, whatever characters it has.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.privacy import policy
from tidemill.operators.privacy.protect import SEVERITY, _known
from tidemill.plans.script import reads_only

LENGTH = 24
NAMES = "identity string, value string, pseudonym string, rehydrate boolean"
_MARKER = re.compile(r"\[\[pii:([A-Z_]+):([0-9a-f]+)\]\]")
_ANY = re.compile(r"\[\[(?:pii|redacted|masked):")


def _identity(type_: str = "type"):
    return F.coalesce(_known(policy.SAME_IDENTITY, F.col(type_)), F.col(type_))


def named(values: DataFrame, secret: str) -> DataFrame:
    """NAMES of values (type, value, rehydrate if there is one): whether a value may come back is false once anyone says so."""
    back = F.col("rehydrate") if "rehydrate" in values.columns else F.lit(True)
    rows = values.where("value IS NOT NULL").select(_identity().alias("identity"), "value", F.coalesce(back, F.lit(True)).alias("rehydrate"))
    rows = rows.groupBy("identity", "value").agg(F.bool_and("rehydrate").alias("rehydrate"))
    inner = F.sha2(F.concat(F.lit(secret + "\x01"), F.col("identity"), F.lit("\x00"), F.col("value")), 256)
    return rows.select("identity", "value", F.substring(F.sha2(F.concat(F.lit(secret + "\x02"), inner), 256), 1, LENGTH).alias("pseudonym"), "rehydrate")


def withheld(values: DataFrame) -> DataFrame:
    """identity, value, action of values (type, value, action) that may not be named: of several actions the severest."""
    rows = values.where("value IS NOT NULL AND action NOT IN ('preserve', 'pseudonymize')")
    severity = _known(SEVERITY, F.col("action"))
    return rows.groupBy(_identity().alias("identity"), "value").agg(F.max_by("action", severity).alias("action"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """NAMES of both vaults. A pseudonym that means two things names nothing any more: neither order wins."""
    rows = a.unionByName(b).groupBy("identity", "value", "pseudonym").agg(F.bool_and("rehydrate").alias("rehydrate"))
    refused = rows.where("NOT rehydrate").select("identity", "value").distinct().withColumn("no", F.lit(True))
    rows = rows.join(refused, ["identity", "value"], "left").withColumn("rehydrate", F.col("rehydrate") & F.col("no").isNull()).drop("no")
    one = rows.groupBy("pseudonym", policy.looked_up(F.col("identity"), 1).alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("identity", "value", "rehydrate")).alias("e"))
    return one.where("n = 1").select("e.identity", "e.value", "pseudonym", "e.rehydrate")


def merged_withheld(a: DataFrame, b: DataFrame) -> DataFrame:
    rows = a.unionByName(b)
    return rows.groupBy("identity", "value").agg(F.max_by("action", _known(SEVERITY, F.col("action"))).alias("action"))


def adopted(vault: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the vault with a history's names (type, value, pseudonym), pseudonym and outcome of each: added, same, or conflict if it
    means something else in the vault or in the history itself). What it has, the vault keeps."""
    told = history.select(_identity().alias("identity"), "value", "pseudonym").where("value IS NOT NULL AND pseudonym IS NOT NULL").distinct()
    tag = policy.looked_up(F.col("identity"), 1)
    apart = told.groupBy("pseudonym", tag.alias("tag")).agg(F.count(F.lit(1)).alias("meanings"), F.first(F.struct("identity", "value")).alias("e"))
    now = vault.select("pseudonym", tag.alias("tag"), F.struct("identity", "value").alias("has"))
    outcome = F.when(F.col("meanings") > 1, "conflict").when(F.col("has").isNull(), "added").when(F.col("has") == F.col("e"), "same").otherwise("conflict")
    rows = apart.join(now, ["pseudonym", "tag"], "left").withColumn("outcome", outcome)
    refused = vault.where("NOT rehydrate").select("identity", "value").distinct().withColumn("no", F.lit(True))
    new = rows.where("outcome = 'added'").select("e.identity", "e.value", "pseudonym").join(refused, ["identity", "value"], "left")
    new = new.select("identity", "value", "pseudonym", F.col("no").isNull().alias("rehydrate"))
    return vault.unionByName(new), rows.select("pseudonym", "tag", "outcome")


def resolved(vault: DataFrame, tokens: DataFrame) -> DataFrame:
    """tokens (tag, pseudonym) with the value each stands for, null if it is unknown or may not come back."""
    known = vault.where("rehydrate").select(policy.looked_up(F.col("identity"), 1).alias("tag"), "pseudonym", "value")
    return tokens.join(known, ["tag", "pseudonym"], "left")


# --- statements ----------------------------------------------------------------------------------------------------


def _literals(node, in_like: bool = False):
    """(first and last character, text, whether it is a pattern of LIKE) of the string literals of a parsed plan."""
    kind = node.getClass().getSimpleName()
    if kind == "Literal" and node.dataType().typeName() == "string" and node.value() is not None:
        origin = node.origin()
        if origin.startIndex().isDefined() and origin.stopIndex().isDefined():
            yield origin.startIndex().get(), origin.stopIndex().get(), node.value().toString(), in_like
        return
    methods = dir(node)
    like = kind in ("Like", "ILike", "LikeAll", "LikeAny", "NotLikeAll", "NotLikeAny") or kind == "UnresolvedFunction" and "like" in node.nameParts().toString().lower()
    seen = []
    for name in ("children", "innerChildren", "expressions"):
        if name in methods:
            it = getattr(node, name)().iterator()
            while it.hasNext():
                seen.append(it.next())
    if "cteRelations" in methods:
        it = node.cteRelations().iterator()
        while it.hasNext():
            seen.append(it.next()._2())
    if "plan" in methods and kind not in ("SubqueryAlias",):
        seen.append(node.plan())
    for child in seen:
        yield from _literals(child, like)


def parametrised(spark: SparkSession, sql: str, values: dict[tuple[str, str], str]) -> tuple[str, dict[str, str]]:
    """(the statement with parameters in place of literals that have pseudonyms, the parameters). values: by (tag, pseudonym).
    Refuses pseudonyms that are unknown, and markers anywhere else than in string literals."""
    found = {}
    for first, last, text, like in _literals(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)):
        if _MARKER.search(text):
            found[first, last] = text, found.get((first, last), ("", False))[1] or like
    args, out, at = {}, [], 0
    for (first, last), (text, like) in sorted(found.items()):
        missing = [m.groups() for m in _MARKER.finditer(text) if m.groups() not in values]
        if missing:
            raise ValueError(f"{len(missing)} pseudonyms stand for nothing that may come back")
        if first < at:
            raise ValueError("literals overlap")
        name = f"__sealed{len(args)}"
        own = lambda m, like=like: re.sub(r"([\\%_])", r"\\\1", values[m.groups()]) if like else values[m.groups()]
        args[name] = _MARKER.sub(own, text)
        out += [sql[at:first], f":{name}"]
        at = last + 1
    out.append(sql[at:])
    left = "".join(out)
    if _ANY.search(left):
        raise ValueError("a marker stands where no value can be put in")
    return left, args


def opened(spark: SparkSession, sql: str, vault: DataFrame) -> DataFrame:
    """The rows of a statement that only reads and speaks in a vault's pseudonyms."""
    asked = sorted({m.groups() for m in _MARKER.finditer(sql)})
    values = {}
    if asked:
        tokens = spark.createDataFrame(asked, "tag string, pseudonym string")  # those of one statement
        values = {(r.tag, r.pseudonym): r.value for r in resolved(vault, F.broadcast(tokens)).collect() if r.value is not None}
    left, args = parametrised(spark, sql, values)
    if not reads_only(spark, left):
        raise ValueError("the statement doesn't only read")
    return spark.sql(left, args=args)
