"""Dual-tree Lloyd against comparing every vector with every centroid."""

import hashlib
import math

import numpy as np
import pytest

from tidemill.llm import lloyd as L


def plain(rows, k=16, dims=64, scale=64, rounds=3):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((d2(v, c), i) for i, c in enumerate(cents))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        cents = [[sum(c) // len(own[i]) for c in zip(*own[i])] if i in own else c for i, c in enumerate(cents)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), cents


@pytest.mark.parametrize("n,k,d,size", [(1, 1, 4, 10), (50, 5, 3, 5), (1024, 16, 64, 30), (700, 16, 2, 200), (300, 7, 3, 1), (1000, 16, 2, 1_000_000), (64, 16, 4, 0), (200, 9, 5, L.MOST)])
def test_nearest(n, k, d, size):
    rng = np.random.default_rng(n + d)
    points = rng.integers(-size, size + 1, (n, d))
    cents = points[rng.integers(0, n, k)]
    compared = []
    cluster, distance = L.nearest(points, L.Tree.read(L.cover_tree(points).bytes()), cents, L.cover_tree(cents, leaf=1), compared)
    want = ((points[:, None].astype(np.int64) - cents[None]) ** 2).sum(2)
    assert (cluster == want.argmin(1)).all() and (distance == want.min(1)).all()
    if size in (200, 1_000_000):
        assert compared[0] < n * k / 3  # bounds leave most pairs out


def test_cover_tree_holds_what_it_says():
    points = np.random.default_rng(5).integers(-50, 51, (400, 3))
    t = L.cover_tree(points, leaf=1)
    assert sorted(t.order) == list(range(400)) and (t.lo[0], t.hi[0]) == (0, 400)
    for i in range(len(t.lo)):
        below = points[t.order[t.lo[i] : t.hi[i]]]
        far = np.sqrt(((below - points[t.center[i]]) ** 2).sum(1))
        assert far.max() <= t.radius[i] + 1e-9
        if t.n[i]:  # children share a node's rows out among them
            kids = range(t.first[i], t.first[i] + t.n[i])
            spans = sorted((t.lo[c], t.hi[c]) for c in kids)
            assert spans[0][0] == t.lo[i] and spans[-1][1] == t.hi[i] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
            assert any(t.center[c] == t.center[i] for c in kids)


def test_query_form_on_edges(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 0.3, (5, 64))
    rows = [(i, (base[i % 5] + rng.normal(0, 0.1, 64)).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (900, None), (901, [0.5] * 63), (902, [0.5] * 63 + [None]), (903, [0.5] * 63 + [math.nan]), (904, [0.5] * 63 + [math.inf])]
    rows += [(1000 + i, [0.25] * 64) for i in range(200)]  # a common vector
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v int").repartition(5)
    got, cents = L.clustered(df)
    want, want_cents = plain(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and cents.tolist() == want_cents


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    got, cents = L.clustered(spark.createDataFrame([(1, [0.5] * 64), (2, [-0.5] * 64)], schema))
    assert sorted((r.distance) for r in got.collect()) == [0, 0] and len(cents) == 2
    got, cents = L.clustered(spark.createDataFrame([], schema))
    assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance"]
    huge, _ = L.clustered(spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] + [0.0] * 63)], schema))
    assert sorted(r.vec_id for r in huge.collect()) == [1, 2]
