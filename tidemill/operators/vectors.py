"""Embeddings of texts in batches, and an inverted file over vectors.

Texts that a cache lacks are embedded in batches of like length. The index deals vectors to the lists of their nearest
centroids, which are fitted on a sample of SAMPLE vectors (the least hashes; the only bound, and every vector is indexed).
A search compares a query with the lists nearest to it; the exact one goes on to every list that may still hold something
better: no vector is nearer to a query than its list's centroid is, less the list's radius.

Vectors are compared on the unit sphere, where cosine and distance tell the same. Those of other lengths than most, null or
zero ones can't lie there; they make a list of their own, which every search compares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators.knowledge import uncached
from tidemill.operators.stored import stored

SAMPLE, STEPS, BLOCK, OTHERS, SLACK, DEALT = 16_384, 8, 512, -1, 1e-6, 16_384
BATCH_TEXTS, BATCH_CHARS = 100, 200_000


def embedded(texts: DataFrame, cache: DataFrame, model: str, encode: Callable[[list[str]], np.ndarray], batch: int = BATCH_TEXTS, chars: int = BATCH_CHARS) -> DataFrame:
    """model, key, embedding of the texts (text) that the cache (model, key) lacks, each distinct one once. encode gets at
    most `batch` texts of like length, of `chars` characters together or one."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []

        def out() -> pa.RecordBatch:
            vectors = np.asarray(encode([t for _, t in held]), np.float32)
            if len(vectors) != len(held):
                raise ValueError(f"{len(held)} texts gave {len(vectors)} vectors")
            return pa.RecordBatch.from_arrays([pa.array([model] * len(held)), pa.array([k for k, _ in held]), pa.array(list(vectors), pa.list_(pa.float32()))], names=["model", "key", "embedding"])

        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                # they come by length, so the new one is the longest
                if held and (len(held) >= batch or (len(held) + 1) * len(row[1]) > chars):
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    rows = uncached(texts, cache, model).withColumn("n", F.length("text"))
    return rows.repartitionByRange("n", "key").sortWithinPartitions("n", "key").select("key", "text").mapInArrow(tasks, "model string, key string, embedding array<float>")


# --- index ---------------------------------------------------------------------------------------------------------


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fitted(vectors: DataFrame, lists: int, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> np.ndarray:
    """Centroids of at most `lists` lists: a few rounds of means on the sphere over a sample; as long as most vectors are."""
    rows = vectors.select(F.xxhash64(F.col(key)).alias("h"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL").orderBy("h").limit(sample).collect()
    sizes = np.array([len(r.v) for r in rows])
    if not len(sizes):
        return np.zeros((0, 0))
    dims = int(np.bincount(sizes).argmax())
    x = np.array([r.v for r in rows if len(r.v) == dims], np.float64)
    x = _unit(x[np.isfinite(x).all(axis=1) & (np.abs(x).max(axis=1, initial=0) > 0)])
    centroids = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)] if len(x) else x
    for _ in range(STEPS):
        near = (x @ centroids.T).argmax(axis=1) if len(x) else np.zeros(0, int)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centroids)
    return centroids


def _parted(rows: DataFrame, by: str) -> DataFrame:
    """list, ids and vectors (8 bytes a number, `size` numbers each) in blocks of about BLOCK rows of one list and length."""
    sizes = rows.groupBy("list", "size").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    own = rows.join(sizes, ["list", "size"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    out = own.groupBy("list", "size", "part").agg(F.collect_list(F.struct("id", "v")).alias("r"))
    return out.select("list", F.col("size").alias(f"{by}_size"), F.col("r.id").alias(f"{by}_ids"), F.col("r.v").alias(f"{by}_vectors"))


def sliced(batches: Iterator[pa.RecordBatch], times: int) -> Iterator[pa.RecordBatch]:
    """Parts of batches, of which each row may be repeated `times` and makes DEALT rows at most (or one row's)."""
    step = max(1, DEALT // max(1, times))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _dealt(vectors: DataFrame, centroids: np.ndarray, key: str, vector: str, probes: int) -> DataFrame:
    """id, list, gap (distance of its unit vector to the list's centroid), place, size, v of each vector and its nearest lists;
    those off the sphere have the list OTHERS only."""
    k, dims = centroids.shape

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "list", "gap", "place", "size", "v"]
        for batch in sliced(batches, min(probes, k)):
            raw = [np.array([np.nan if e is None else e for e in (v or [])], np.float64) for v in batch.column(1).to_pylist()]
            sound = np.array([k > 0 and len(v) == dims and bool(np.isfinite(v).all()) and bool(v.any()) for v in raw], bool)
            n = min(probes, k)
            of, lists, gaps, place = [np.flatnonzero(~sound)], [np.full((~sound).sum(), OTHERS)], [np.zeros((~sound).sum())], [np.zeros((~sound).sum(), np.int64)]
            if sound.any():
                x = _unit(np.stack([v for v, s in zip(raw, sound) if s]))
                gap = np.sqrt(np.maximum(2 - 2 * x @ centroids.T, 0))
                near = np.argsort(gap, axis=1, kind="stable")[:, :n]
                of.append(np.repeat(np.flatnonzero(sound), n))
                lists.append(near.ravel())
                gaps.append(np.take_along_axis(gap, near, 1).ravel())
                place.append(np.tile(np.arange(n), sound.sum()))
            at = np.concatenate(of)
            arrays = [batch.column(0).take(pa.array(at)), pa.array(np.concatenate(lists), pa.int32()), pa.array(np.concatenate(gaps)), pa.array(np.concatenate(place), pa.int32()), pa.array([len(raw[i]) for i in at], pa.int32()), pa.array([raw[i].tobytes() for i in at], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(tasks, "id long, list int, gap double, place int, size int, v binary")


class Index:
    """The lists of all vectors, stored in blocks, with the lists' radii (one row for each list)."""

    def __init__(self, vectors: DataFrame, lists: int = 256, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE):
        self.centroids = fitted(vectors, lists, key, vector, sample)
        self.rows = stored(_dealt(vectors, self.centroids, key, vector, 1), "index-rows")
        self.blocks = stored(_parted(self.rows, "x"), "index-blocks")
        self.radii = {r["list"]: r.radius for r in self.rows.groupBy("list").agg(F.max("gap").alias("radius")).collect()}

    def _met(self, asked: DataFrame, k: int) -> DataFrame:
        """query, id, score: of each query the k best of each block it meets. asked: id, list, size, v."""
        pairs = _parted(asked, "q").join(self.blocks, "list")

        def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    q_size, q_ids, q, x_size, x_ids, x = (batch.column(c)[i].as_py() for c in range(6))
                    n = min(q_size, x_size)  # uneven ones are compared over the shorter length
                    a = np.frombuffer(b"".join(q), np.float64).reshape(len(q_ids), q_size)[:, :n]
                    b = np.frombuffer(b"".join(x), np.float64).reshape(len(x_ids), x_size)[:, :n]
                    norms = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
                    score = np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 0)
                    ids = np.array(x_ids, np.int64)
                    for row, own in zip(q_ids, score):
                        # all that may be among the k best when scores are rounded
                        least = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else -np.inf
                        best = np.flatnonzero(own >= least - SLACK)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), row)), pa.array(ids[best]), pa.array(own[best])], names=["query", "id", "score"])

        names = ["q_size", "q_ids", "q_vectors", "x_size", "x_ids", "x_vectors"]
        return pairs.select(*names).mapInArrow(tasks, "query long, id long, score double")

    def probes(self, queries: DataFrame, k: int = 10, recall: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> int:
        """How many lists a search has to compare to find `recall` of what is nearest to some queries, which the exact one tells."""
        dealt = _dealt(queries, self.centroids, key, vector, max(1, len(self.centroids)))
        lists = dealt.select(F.col("id").alias("query"), "list", "place")
        found = self.search(queries, k, exact=True, key=key, vector=vector).select("query", "id").join(self.rows.select("id", "list"), "id").join(lists, ["query", "list"])
        places = found.groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy("place").collect()  # a row for each list at most
        need, total = recall * sum(r.n for r in places), 0
        for r in places:
            total += r.n
            if total >= need:
                return r.place + 1
        return 1

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False, digits: int = 6, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """query, id, score (rounded), place (from 1; ties by id) of each query's k best, among the `probes` nearest lists, or
        with `exact` among all vectors."""
        lists = max(1, len(self.centroids))
        dealt = stored(_dealt(queries, self.centroids, key, vector, lists if exact else probes), "index-queries")
        # a query off the sphere meets every list, and every query the vectors off it
        every = [OTHERS, *range(len(self.centroids))]
        columns = ["id", "list", "size", "v"]
        off = dealt.where(F.col("list") == OTHERS).withColumn("list", F.explode(F.array(*[F.lit(i) for i in every]))).select(*columns)
        on = dealt.where(F.col("list") != OTHERS)
        first = on.where(F.col("place") < probes).select(*columns).unionByName(off).unionByName(on.where("place = 0").withColumn("list", F.lit(OTHERS)).select(*columns))
        found = self._met(first, k)
        if exact:
            found = stored(found, "index-first")
            # a score that the k-th best of the first lists has bounds the distance of what may be better
            worst = self._best(found, k, 12).groupBy("query").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("n"))
            reach = F.when(F.col("n") < k, F.lit(3.0)).otherwise(F.sqrt(F.greatest(2 - 2 * F.col("worst"), F.lit(0.0))) + 10 * SLACK)
            radius = F.element_at(F.create_map(*[F.lit(v) for item in (self.radii or {OTHERS: 0.0}).items() for v in item]), F.col("list"))
            rest = on.where(F.col("place") >= probes).join(worst, on["id"] == F.col("query"), "left").where((F.col("gap") - radius <= F.coalesce(reach, F.lit(3.0))) & radius.isNotNull())
            found = found.unionByName(self._met(rest.select(*columns), k))
        return self._best(found, k, digits)

    @staticmethod
    def _best(found: DataFrame, k: int, digits: int) -> DataFrame:
        rows = found.distinct().withColumn("score", F.round("score", digits))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        return rows.withColumn("place", place).where(F.col("place") <= k)
