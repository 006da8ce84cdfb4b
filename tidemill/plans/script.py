"""Scripts of statements over spark.sql.

Spark parses and analyses; a statement that only reads is told by the class of its parsed plan.
"""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tidemill.functions.text import PARTING, STOP_WORDS

#: Plan classes at the root of statements that change something or run commands.
_WRITES = ("Insert", "Create", "Drop", "Delete", "Update", "Merge", "Alter", "Truncate", "Replace", "Set", "Add", "Rename", "Load", "Refresh", "Repair", "Analyze", "Cache", "Uncache", "Command")
_READ_COMMANDS = ("Describe", "Show", "Explain")


@dataclass
class Result:
    kind: str  # rows, exec or error
    rows: DataFrame | None = None
    truncated: bool = False
    message: str = ""


def register_functions(spark: SparkSession) -> None:
    """Functions that statements may call, text_tokens and mask_value: expressions, no Python. A null text has no tokens."""
    stops, parting = ", ".join(f"'{w}'" for w in STOP_WORDS), PARTING.replace("\\", "\\\\").replace("'", "\\'")
    apart = f"regexp_replace(regexp_replace(coalesce(v, ''), '([a-z0-9])([A-Z])', '$1 $2'), '{parting}', ' ')"
    kept = f"filter(split(lower({apart}), '\\\\s+'), w -> length(w) >= 2 AND w NOT IN ({stops}))"
    cut = lambda n: f"substring(w, 1, length(w) - {n})"
    singular = f"CASE WHEN length(w) <= 3 THEN array(w) WHEN endswith(w, 'ies') THEN array(w, concat({cut(3)}, 'y')) WHEN w RLIKE '(s|x|z|ch|sh)es$' THEN array(w, {cut(2)}) WHEN endswith(w, 's') AND NOT endswith(w, 'ss') THEN array(w, {cut(1)}) ELSE array(w) END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION text_tokens(v STRING) RETURNS ARRAY<STRING> RETURN flatten(transform({kept}, w -> {singular}))")
    bare = "regexp_replace(v, '[^\\\\p{L}\\\\p{N}]', '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION mask_value(v STRING) RETURNS STRING RETURN CASE WHEN length({bare}) >= 8 THEN right({bare}, 4) ELSE '' END")


def plan_class(spark: SparkSession, statement: str) -> str:
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    return plan.getClass().getSimpleName()


def reads_only(spark: SparkSession, statement: str) -> bool:
    name = plan_class(spark, statement)
    return name.startswith(_READ_COMMANDS) or not (name.startswith(_WRITES) or name.endswith("Command"))


def problem(spark: SparkSession, statement: str) -> str | None:
    """What analysis has against a statement, without running it (EXPLAIN would give it as rows)."""
    try:
        if not reads_only(spark, statement):
            return "the statement doesn't only read"
        spark.sql(statement)
    except PySparkException as e:
        return str(e).split("\n")[0]
    return None


def run(spark: SparkSession, statements: list[str], args: list | dict | None = None, most: int = 1000, read_only: bool = True, seconds: float | None = 60) -> list[Result]:
    """Runs statements in turn; the first error ends the script, results before it stay. Parameters go to a single statement.

    A result's rows are bounded by `most` (0: 1000); whether there are more is told by reading one row beyond.
    """
    most, out = most or 1000, []
    for statement in (s for s in statements if s.strip()):
        tag = f"script-{uuid.uuid4().hex}"
        spark.addTag(tag)
        timer = threading.Timer(seconds, lambda t=tag: spark.interruptTag(t)) if seconds else None
        try:
            if read_only and not reads_only(spark, statement):
                out.append(Result("error", message="only statements that read are run"))
                break
            df = spark.sql(statement, args=args) if args and len(statements) == 1 else spark.sql(statement)
            if not df.columns:
                out.append(Result("exec"))
                continue
            if timer:
                timer.start()
            n = len(df.limit(most + 1).take(most + 1))
            out.append(Result("rows", df.limit(most), n > most))
        except PySparkException as e:
            out.append(Result("error", message=str(e).split("\n")[0]))
            break
        finally:
            if timer:
                timer.cancel()
            spark.removeTag(tag)
    return out
