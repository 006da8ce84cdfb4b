"""What queries send between tasks, and what tasks hold."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import stored
from tidemill.operators.privacy import detect, protect


def sent(spark):
    """Bytes of all shuffles so far."""
    context, jvm = spark.sparkContext, spark._jvm
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("few", [stored.FEW, 0])
def test_texts_that_stay_are_not_shuffled(spark, few, monkeypatch):
    monkeypatch.setattr(stored, "FEW", few)
    monkeypatch.setattr(detect, "SPREAD_BYTES", 0)  # small tables are dealt anew before detection
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choices("bcdfghklmnprst", k=7)) for _ in range(400))) for i in range(600)]
    rows += [(1000, "write to amy.miller@example.org or ben"), (1000, "amy.miller@example.org"), (None, "that is amy.miller@example.org."), (1001, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    before = sent(spark)
    out, vault = protect.protected(df, "id", "key")
    got = out.collect()
    back = protect.restored(out, vault, "id").collect()
    assert sorted(map(repr, back)) == sorted(map(repr, df.collect()))
    assert len(got) == len(rows) and sum("[[pii:EMAIL:" in (r.text or "") for r in got) == 3 and not any("amy" in (r.text or "") for r in got)
    if few:
        assert sent(spark) - before < 0.1 * sum(len(text or "") for _, text in rows)


def test_values_that_begin_alike_meet_only_their_texts(spark):
    """A text has the first words of all values, and the whole of its own."""
    df = spark.createDataFrame([(i, f"go to https://www.example.com/page{i}/view now") for i in range(200)], "id long, text string")
    values = spark.createDataFrame([(f"https://www.example.com/page{i}/view", "URL") for i in range(200)], "value string, type string")
    begin = stored.mark()
    got = protect.known_spans(df, values, "id").collect()
    assert sorted((r.id, r.start, r.end) for r in got) == [(i, 6, 6 + len(f"https://www.example.com/page{i}/view")) for i in range(200)]
    met = next(p for p in stored._PATHS[begin:] if "protect-met" in p)
    assert max(len(r.known) for r in spark.read.parquet(met).collect()) == 1


def test_tokens_need_no_python(spark):
    from tidemill.functions import text as X
    from tidemill.plans import script

    script.register_functions(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    more = spark.createDataFrame([("It's camelCase, parties/boxes [lists] of 'glasses' bus\\path",), ("",), (" \u00c9t\u00e9s\tNIES ies es",)], "text string")
    got = docs.union(more).select(F.expr("text_tokens(text)").alias("t"), X.tokens(F.col("text")).alias("want"))
    assert all(r.t == r.want for r in got.collect()) and "Python" not in got._jdf.queryExecution().toString()


def test_intervals_are_dealt_by_their_number(spark, monkeypatch):
    from tidemill.plans import owned, registry

    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, registry.queries()["i10_span_merge"](spark, sf).collect()))
    monkeypatch.setattr(owned, "INTERVALS", 500)
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert owned.intervals(spark, sf).rdd.getNumPartitions() == -(-n // 500) > 4
    assert sorted(map(tuple, registry.queries()["i10_span_merge"](spark, sf).collect())) == want
