"""What operators send between tasks, and what is left of it."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemill.llm import ngram_join as J
from tidemill.llm import packing
from tidemill.operators import stored


def test_token_rows_go_in_pieces():
    rng = np.random.default_rng(1)
    token, item = rng.integers(-(2**63), 2**63 - 1, (2, 300_000))
    token[1000:2000] = 5  # links of one item: they are spread by their own
    n = np.where(token == 5, J.LINK, 7).astype(np.int32)
    parts = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in (token, item, n)], names=["token", "item", "n"]) for i in range(0, 300_000, 50_000)]
    rows = [r for b in J.dealt(iter(parts)) for r in b.to_pylist()]
    assert len(rows) < 300_000 / 20 and max(len(r["rows"]) for r in rows) < 20 * 200
    back = J.undealt([r["rows"] for r in rows])
    assert (np.diff(back[0]) >= 0).all() and sorted(zip(*(c.tolist() for c in back))) == sorted(zip(token.tolist(), item.tolist(), n.tolist()))
    of = {}
    for r in rows:
        for t in np.frombuffer(r["rows"], np.int64, len(r["rows"]) // 20).tolist():
            assert t == 5 or of.setdefault(t, r["bucket"]) == r["bucket"]


def test_pairs_that_cannot_be_similar_go_early(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64 - 1, 300, dtype=np.uint64)
    sets = {1: base, 2: np.append(base[15:], rng.integers(0, 2**64 - 1, 15, dtype=np.uint64)), 3: np.append(base[:90], rng.integers(0, 2**64 - 1, 210, dtype=np.uint64)), 4: rng.integers(0, 2**64 - 1, 60_000, dtype=np.uint64)}
    sets[5] = np.append(sets[4][100:], rng.integers(0, 2**64 - 1, 100, dtype=np.uint64))
    known = spark.createDataFrame([(k, len(s), bytearray(J.sketch(s))) for k, s in sets.items()], "item long, n long, sketch binary")
    pairs = spark.createDataFrame([(1, 2, False), (1, 3, False), (2, 3, True), (4, 5, False), (1, 4, False)], "a long, b long, hot boolean")
    assert sorted((r.a, r.b, r.hot) for r in J.may_be_similar(pairs, known, 90).collect()) == [(1, 2, False), (2, 3, True), (4, 5, False)]


def test_shuffles_go_when_tables_are_stored(spark, monkeypatch):
    monkeypatch.setattr(stored.swept, "__defaults__", (0,))
    held = lambda: spark._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    before = held()
    for i in range(30):
        stored.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), f"swept-{i}")
    for _ in range(40):
        if held() - before < 10:
            break
        time.sleep(0.5)
    assert held() - before < 10


def test_workers_forget_words(spark):
    def known(batches):
        from tidemill.llm.packing import word_tokens

        n = word_tokens.cache_info().currsize
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    docs = spark.range(400, numPartitions=4).selectExpr("id AS doc_id", "concat('some words ', id) AS text")
    spark.range(4, numPartitions=4).mapInArrow(lambda b: (packing.word_tokens.cache_clear(), b)[1], "id long").count()
    assert packing.packed(docs, packing.word_vocabulary, ids=False, keep=False).agg(F.sum("length")).first()[0] > 400
    assert {r.n for r in spark.range(4, numPartitions=4).mapInArrow(known, "n long").collect()} == {0}
