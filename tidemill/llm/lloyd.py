"""Centroid clustering: Lloyd's rounds on whole numbers, with a tree over the vectors and one over the centroids.

Vectors are dealt in blocks of BLOCK rows, as they come, so none is shuffled. Each block has a cover tree, built once and
stored: at each scale (halved from level to level) the nodes are a net, every node's point is further than the scale from
the others', and within twice the scale of its parent's. A round builds the same kind of tree over the centroids and goes
down both at once: a pair of nodes is left out if even its nearest members are further apart than the furthest member of
the vectors' node is from some centroid. What remains at the leaves is compared exactly, in whole numbers. A node with one
candidate left is assigned as a whole. Tasks give one sum for each centroid; only these (k * dims numbers) reach the driver.

Defined cases: a vector is kept if it has exactly `dims` components, none null or non-finite. Components are whole numbers
floor(scale * x), held within 2^27 either way, so that squared distances of 64 components fit in 64 bits. A null id hashes
as an empty one; repeated rows are vectors of their own (of two equal centroids the one with the smaller number gets all).
With fewer vectors than k all are centroids; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import clash_free, stored, table

BLOCK, LEAF, MOST = 1024, 8, 1 << 27
K, DIMS, SCALE, ROUNDS, SEED = 16, 64, 64, 3, "1"


class Tree:
    """A cover tree in arrays. order: rows by node; lo, hi: a node's rows there; center: a row; radius: to its furthest row;
    first, n: its children, which are next to each other."""

    PARTS = (("order", "<i4"), ("lo", "<i4"), ("hi", "<i4"), ("center", "<i4"), ("radius", "<f8"), ("first", "<i4"), ("n", "<i4"))

    def __init__(self, **parts: np.ndarray):
        self.__dict__.update(parts)

    def bytes(self) -> bytes:
        head = np.array([len(self.order), len(self.lo)], "<i4").tobytes()
        return head + b"".join(getattr(self, name).astype(kind).tobytes() for name, kind in self.PARTS)

    @classmethod
    def read(cls, data: bytes) -> Tree:
        rows, nodes = np.frombuffer(data, "<i4", 2)
        parts, at = {}, 8
        for name, kind in cls.PARTS:
            parts[name] = np.frombuffer(data, kind, rows if name == "order" else nodes, at)
            at += parts[name].nbytes
        return cls(**parts)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The cover tree of at least one row of whole numbers. Nodes of at most `leaf` rows have no children."""
    rows = len(points)
    x = points.astype(np.float64)
    square = (x * x).sum(1)
    apart = np.sqrt(np.maximum(square[:, None] + square - 2 * (x @ x.T), 0))
    np.fill_diagonal(apart, 0)

    # each level's net, from the widest scale down: (scale, node) of each row that becomes one, under its nearest node
    near, owner = apart[0].copy(), np.zeros(rows, np.int64)
    children: list[list[tuple[float, int]]] = [[] for _ in range(rows)]
    placed = np.zeros(rows, bool)
    placed[0] = True
    scale = 2.0 ** np.ceil(np.log2(near.max())) if near.max() > 0 else 0.0
    while near.max() > 0 and scale > 0.25:
        scale /= 2
        above = owner.copy()
        while True:
            far = near > scale
            i = int(far.argmax())
            if not far[i]:
                break
            children[above[i]].append((scale, i))
            placed[i] = True
            closer = apart[i] < near
            near[closer] = apart[i][closer]
            owner[closer] = i
            near[i], owner[i] = 0, i
    for i in np.flatnonzero(~placed):  # equal to their owner
        children[owner[i]].append((0.0, int(i)))

    # rows in the order of a walk, so that the rows below a node are next to each other
    order: list[int] = []
    span: dict[tuple[int, int], tuple[int, int]] = {}  # (row, children passed) -> its rows
    todo: list[tuple[int, int, bool]] = [(0, 0, False)]
    while todo:
        i, passed, done = todo.pop()
        own = children[i]
        if done:
            span[i, passed] = (span[i, passed][0], len(order))
            continue
        span[i, passed] = (len(order), 0)
        todo.append((i, passed, True))
        if passed == len(own):
            order.append(i)
            continue
        end = passed
        while end < len(own) and own[end][0] == own[passed][0]:
            end += 1
        todo += [(c, 0, False) for _, c in own[passed:end]]
        todo.append((i, end, False))  # the row itself, at the next level
    # nodes breadth first
    at = np.array(order)
    lo, hi, center, radius, first, n = [], [], [], [], [], []
    queue = [(0, 0)]
    for i, passed in queue:
        a, b = span[i, passed]
        own = children[i]
        lo.append(a)
        hi.append(b)
        center.append(i)
        gap = x[at[a:b]] - x[i]
        radius.append(float(np.sqrt((gap * gap).sum(1).max())))
        if b - a <= leaf or passed == len(own):
            first.append(0)
            n.append(0)
            continue
        end = passed
        while end < len(own) and own[end][0] == own[passed][0]:
            end += 1
        first.append(len(queue))
        n.append(end - passed + 1)
        queue.append((i, end))
        queue += [(c, 0) for _, c in own[passed:end]]
    return Tree(order=at, lo=np.array(lo), hi=np.array(hi), center=np.array(center), radius=np.array(radius), first=np.array(first), n=np.array(n))


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers starts[i], starts[i] + 1, ..., counts[i] of them; and i for each."""
    which = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return starts[which] + np.arange(len(which)) - before[which], which


def nearest(points: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree, counted: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: the smaller number) and the squared distance, exactly.

    All pairs of one vectors' node go on together: first their centroids' nodes are opened, as long as one is wider than
    the node, then the node itself. counted gets the number of pairs compared exactly, for tests.
    """
    x, y = points.astype(np.float64), centroids.astype(np.float64)
    cluster = np.zeros(len(points), np.int64)
    left_rows, left_centroids = [], []
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(a):
        gap = x[tree.center[a]] - y[over.center[b]]
        d = np.sqrt((gap * gap).sum(1))
        ra, rb = tree.radius[a], over.radius[b]
        slack = 1e-9 * (1 + d + ra + rb)
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        bound = np.repeat(np.minimum.reduceat(d + ra + slack, first), np.diff(np.r_[first, len(a)]))
        keep = d - ra - rb - slack <= bound
        a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        counts = np.diff(np.r_[first, len(a)])
        whole = over.hi[b] - over.lo[b] == 1
        alone = np.repeat(counts == 1, counts) & whole
        rows, which = _spread(tree.lo[a[alone]], (tree.hi - tree.lo)[a[alone]])
        cluster[tree.order[rows]] = over.order[over.lo[b[alone]]][which]
        opens_b = (over.n[b] > 0) & ((rb >= ra) | (tree.n[a] == 0))
        waits = np.repeat(np.maximum.reduceat(opens_b, first), counts)  # a node waits until its centroids' nodes are open
        opens_a = ~waits & ~alone & (tree.n[a] > 0)
        ends = ~waits & ~alone & (tree.n[a] == 0)
        rows, which = _spread(tree.lo[a[ends]], (tree.hi - tree.lo)[a[ends]])
        heads, part = _spread(over.lo[b[ends]][which], (over.hi - over.lo)[b[ends]][which])
        left_rows.append(tree.order[rows][part])
        left_centroids.append(over.order[heads])
        stay = waits & ~opens_b
        below_b, by_b = _spread(over.first[b[opens_b]], over.n[b[opens_b]])
        below_a, by_a = _spread(tree.first[a[opens_a]], tree.n[a[opens_a]])
        a, b = np.r_[a[stay], a[opens_b][by_b], below_a], np.r_[b[stay], below_b, b[opens_a][by_a]]
        sort = np.lexsort((b, a))
        a, b = a[sort], b[sort]
    rows, heads = np.concatenate(left_rows), np.concatenate(left_centroids)
    if counted is not None:
        counted.append(len(rows))
    if len(rows):
        sort = np.lexsort((heads, rows))
        rows, heads = rows[sort], heads[sort]
        apart = np.concatenate([_exact(points[rows[i : i + 8192]], centroids[heads[i : i + 8192]]) for i in range(0, len(rows), 8192)])
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        least = np.repeat(np.minimum.reduceat(apart, first), np.diff(np.r_[first, len(rows)]))
        hits = np.flatnonzero(apart == least)
        hits = hits[np.r_[True, rows[hits][1:] != rows[hits][:-1]]]
        cluster[rows[hits]] = heads[hits]
    return cluster, _exact(points, centroids[cluster])


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a.astype(np.int64) - b
    return np.einsum("ij,ij->i", gap, gap)


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the kept vectors as whole numbers. vectors has vec_id and embedding."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    own = clash_free(vectors, ["vec_id", "embedding"]).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    # limits before the product: floor(scale * x) of a finite x may be beyond any whole number's range
    within = lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c * scale, F.lit(-float(MOST))), F.lit(float(MOST)))), F.lit(-MOST)), F.lit(MOST))
    return own.where((F.size("x") == dims) & sound).select("vec_id", F.transform("x", within).cast("array<int>").alias("v"))


def first_centroids(kept: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The k vectors with the least sha256 of "seed:vec_id" (ties: by components), a top-k in each task and then over them."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in kept.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()], np.int64)


def blocks(kept: DataFrame, dims: int, size: int = BLOCK) -> DataFrame:
    """ids, points and tree of each block of rows."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def out(batch: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
            v = batch.column(1).combine_chunks() if isinstance(batch, pa.Table) else batch.column(1)
            points = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            ids = pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([ids, pa.array([points.astype("<i4").tobytes()]), pa.array([cover_tree(points).bytes()])], names=["ids", "points", "tree"])

        for batch in batches:
            for i in range(0, batch.num_rows, size):
                held.append(batch.slice(i, size))
                count += held[-1].num_rows
                while count >= size:
                    rows = pa.Table.from_batches(held)
                    yield out(rows.slice(0, size))
                    held = rows.slice(size).to_batches()
                    count -= size
        if count:
            yield out(pa.Table.from_batches(held))

    return kept.mapInArrow(made, "ids array<long>, points binary, tree binary")


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    over = cover_tree(centroids, leaf=1)
    for batch in batches:
        for ids, points, tree in zip(*(batch.column(c) for c in range(3))):
            x = np.frombuffer(points.as_py(), "<i4").reshape(-1, centroids.shape[1]).astype(np.int64)
            yield (ids.values, x, *nearest(x, Tree.read(tree.as_py()), centroids, over))


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the means; those without vectors stay."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, x, cluster, _ in _assigned(batches, centroids):
            sort = np.argsort(cluster, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(cluster[sort]) > 0])
            total[cluster[sort][first]] += np.add.reduceat(x[sort], first)
            count += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = trees.mapInArrow(sums, "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums"))
    new = centroids.copy()
    for r in total.collect():
        new[r.cluster] = [s // r.n for s in r.sums]
    return new


def clustered(vectors: DataFrame, k: int = K, dims: int = DIMS, scale: int = SCALE, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and squared distance of each kept vector after `rounds` rounds; and the centroids (k * dims, on the driver)."""
    kept = whole_vectors(vectors, dims, scale)
    schema = "vec_id long, cluster int, distance long"
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema), centroids
    trees = stored(blocks(kept, dims), "cover-trees")
    for _ in range(rounds):
        centroids = moved(trees, centroids)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in _assigned(batches, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(rows, schema), centroids


def op11_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: clusters, distances and inertias of all kept vectors."""
    found, centroids = clustered(table(spark, sf_dir, "embeddings"))
    found = stored(found, "clusters")
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    each = [(c, inertia.get(c, 0), sum(inertia.values()), d) for c, d in enumerate(digest)]
    known = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_NEAREST = """
  SELECT r, vec_id, v, c, d FROM (SELECT r, vec_id, v.v, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS i FROM (
    SELECT r, vec_id, v.v, c, CAST(list_sum(list_transform(list_zip(v.v, {c}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, {c}) v) v WHERE i = 1"""
_MEANS = """
  SELECT c, list(m ORDER BY p) AS v FROM (
    SELECT c, p, CAST((s - (s % n + n) % n) // n AS BIGINT) AS m FROM (
      SELECT c, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS p FROM {a}) GROUP BY c, p)) GROUP BY c
  UNION ALL SELECT c, v FROM {c} WHERE c NOT IN (SELECT c FROM {a})"""

#: Rounds as they are said, each vector against each centroid.
OP11_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE len(embedding) = 64),
v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(x, lambda y: CAST(floor(64 * y) AS BIGINT)) AS v FROM e WHERE len(list_filter(x, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v ORDER BY h, v LIMIT 16)),
""" + "".join(f"a{i} AS MATERIALIZED ({_NEAREST.format(c=f'c{i}')}),\nc{i + 1} AS MATERIALIZED ({_MEANS.format(a=f'a{i}', c=f'c{i}')}),\n" for i in range(3)) + f"""
a3 AS MATERIALIZED ({_NEAREST.format(c='c3')})
SELECT vec_id, CAST(a3.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a3.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON a3.c = c3.c
"""
