"""Importance resampling towards a target: an external count over packed streams of feature buckets.

Runs of one to three words are hashed into BUCKETS buckets. A first pass over the texts writes, for blocks of documents,
one packed stream of 16-bit buckets with the documents' offsets in it. A second one reads streams only: each block is
sorted and run-length encoded, runs are merged per task and then over tasks, which gives each bucket's count. The gains of
the buckets (the logarithm of how much likelier the target has them; BUCKETS whole numbers) go to all tasks, and a third
pass gathers them along the streams and adds them up by offset with np.add.reduceat. Noise from a hash of the id turns the
weights into a draw without replacement: the highest scores of documents with enough words.

Ranks come from one shuffle by ranges of scores; a rank is the number of rows in earlier ranges and before it in its own.

Defined cases: a null text has no words, no features and weight 0; a null id hashes as an empty one and comes after others
among ties; repeated rows are documents of their own. Empty tables (documents, target or both) count as no features.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import clash_free, stored, table

BUCKETS, BLOCK_FEATURES, CACHE_WORDS = 10_000, 1 << 20, 400_000
PERCENT, LEAST_WORDS, SEED = 5, 20, "42"
#: What is no word, of lower-cased ASCII: all but letters and digits. Bytes beyond ASCII belong to words.
_APART = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


class Streams:
    """Buckets of texts' features.

    A checksum of joined strings follows from those of its parts: that of the left part is carried over the right one's
    length, which is linear in its bits, and the right one's is added. So words are hashed once, and the checksums of runs
    come from tables of four bytes, for all words of a block at once.
    """

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.lengths: dict[int, int] = {}
        self.tables: list[np.ndarray] = []
        self.words: list[tuple[int, int, int, int]] = []  # checksum, that with a space after it, tables of its length and one more

    def _table(self, length: int) -> int:
        """The number of the table that carries a checksum over so many bytes."""
        if length not in self.lengths:
            zeros = bytes(length)
            rest = zlib.crc32(zeros)
            bits = np.array([zlib.crc32(zeros, 1 << b) ^ rest for b in range(32)], np.uint32).reshape(4, 8)
            t = np.zeros((4, 256), np.uint32)
            for b in range(8):
                t[:, 1 << b : 2 << b] = t[:, : 1 << b] ^ bits[:, b : b + 1]
            self.lengths[length] = len(self.tables)
            self.tables.append(t)
        return self.lengths[length]

    def _learn(self, word: bytes) -> int:
        crc = zlib.crc32(word)
        self.known[word] = len(self.words)
        self.words.append((crc, zlib.crc32(b" ", crc), self._table(len(word)), self._table(len(word) + 1)))
        return self.known[word]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The stream of the texts, each one's number of words, and each one's number of features."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        at, n_words = [], []
        get, learn = self.known.get, self._learn
        for text in texts:
            words = (text or "").encode().lower().translate(_APART).split()
            n_words.append(len(words))
            at += [i if (i := get(w)) is not None else learn(w) for w in words]
        n = np.array(n_words, np.int64)
        if not at:
            return np.zeros(0, "<u2"), n, n
        crc, spaced, own, longer = np.array(self.words, np.uint32).T[:, at]
        tables = np.concatenate([t.ravel() for t in self.tables])

        def carried(c: np.ndarray, number: np.ndarray) -> np.ndarray:
            i = number.astype(np.int64) << 10
            return tables[i + (c & 255)] ^ tables[i + 256 + (c >> 8 & 255)] ^ tables[i + 512 + (c >> 16 & 255)] ^ tables[i + 768 + (c >> 24)]

        left = np.repeat(np.cumsum(n), n) - np.arange(len(at))  # words from here to the end of the text
        runs = np.zeros((len(at), 3), np.uint32)
        runs[:, 0] = crc
        runs[:-1, 1] = carried(spaced[:-1], own[1:]) ^ crc[1:]
        runs[:-2, 2] = carried(carried(spaced[:-2], longer[1:-1]) ^ spaced[1:-1], own[2:]) ^ crc[2:]
        there = left[:, None] >= np.array([1, 2, 3])
        return (runs[there] % self.buckets).astype("<u2"), n, np.where(n > 1, 3 * n - 3, n)


def streams(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """ids, n_words, offsets (where each document begins, then the end) and buckets (16 bits each) of blocks of rows (id, text)."""
    if buckets > 1 << 16:
        raise ValueError("buckets are numbers of 16 bits")
    names = ["ids", "n_words", "offsets", "buckets"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Streams(buckets)
        ids, words, counts, parts, size = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            offsets = np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int64)
            lists = [pa.array([v], pa.list_(pa.int64())) for v in (ids, np.concatenate(words), offsets)]
            return pa.RecordBatch.from_arrays([*lists, pa.array([b"".join(parts)], pa.binary())], names=names)

        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                stream, n, m = of(part.column(1).to_pylist())
                ids += part.column(0).to_pylist()
                words.append(n)
                counts.append(m)
                parts.append(stream.tobytes())
                size += len(stream)
                if size >= BLOCK_FEATURES:
                    yield block()
                    ids, words, counts, parts, size = [], [], [], [], 0
        if ids:
            yield block()

    return rows.mapInArrow(pack, "ids array<long>, n_words array<long>, offsets array<long>, buckets binary")


def bucket_counts(packed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket has: runs of sorted streams, merged. One number for each bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                stream = np.sort(np.frombuffer(data.as_py(), "<u2"), kind="stable")
                first = np.flatnonzero(np.r_[True, stream[1:] != stream[:-1]]) if len(stream) else np.zeros(0, np.int64)
                total[stream[first]] += np.diff(np.r_[first, len(stream)])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in packed.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier the target has each bucket than the source, both smoothed by one."""
    n, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_source + n) / ((s + 1.0) * (all_target + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(packed: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each document of the streams."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, offsets, data in zip(*batch.columns):
                at = offsets.values.to_numpy()
                n = np.diff(at)
                weight = np.zeros(len(n), np.int64)
                some = n > 0  # an empty span would take its neighbour's gain
                if some.any():
                    weight[some] = np.add.reduceat(gain[np.frombuffer(data.as_py(), "<u2")], at[:-1][some])
                doc = ids.values
                score = weight + np.array([noise(d, seed) for d in doc.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([doc, words.values, pa.array(n), pa.array(weight), pa.array(score)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return packed.mapInArrow(gather, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scores with rank: 1, 2, 3, ... for the drawn documents, null for the others."""
    fit = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    key = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rows = scores.withColumn("fit", fit).repartitionByRange(*key).sortWithinPartitions(*key)
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "ranges")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before, total, starts = 0, 0, []
    # one row for each range
    for r in sorted(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("fit").alias("fit")).collect()):
        starts.append((r.part, before))
        before, total = before + r.n, total + r.fit
    first = scores.sparkSession.createDataFrame(starts, "part long, before long")
    rank = F.col("before") + within + 1
    drawn = rows.withColumn("part", part).join(F.broadcast(first), "part")
    return drawn.withColumn("rank", F.when(F.col("fit") & (rank <= percent * total // 100), rank)).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each of docs (doc_id, text), resampled towards target (text)."""
    own = lambda df, key: clash_free(df, [key, "text"]).select(F.col(f"`{key}`").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    packed = stored(streams(own(docs, "doc_id"), buckets), "streams")
    wanted = bucket_counts(streams(own(target, "item_id"), buckets), buckets)
    scores = stored(scored(packed, gains(bucket_counts(packed, buckets), wanted), seed), "scores")
    return ranked(scores, percent, least_words)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: documents drawn towards the benchmark's texts."""
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_RUNS = (
    "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), "
    "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"
)
#: A checksum's table for four bits, fixed values of CRC-32.
_NIBBLES = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
_STEP = "xor(({n})[CAST(({c} & 15) + 1 AS INTEGER)], {c} >> 4)"
#: Two steps a byte: its low half is mixed in with the first, its high half stands in the second's low bits.
_BYTE = _STEP.format(n=_NIBBLES, c="(" + _STEP.format(n=_NIBBLES, c="xor(c, b)") + ")")
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT {_WORDS} AS w FROM benchmark),
f AS (SELECT r, unnest({_RUNS}) AS f FROM d),
g AS (SELECT unnest({_RUNS}) AS f FROM t),
u AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM f UNION SELECT f FROM g)),
k AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, b: {_BYTE}, 4294967295), 4294967295) % 10000 AS b FROM u),
fb AS MATERIALIZED (SELECT r, b FROM f JOIN k USING (f)),
s AS (SELECT b, count(*) AS s FROM fb GROUP BY b),
m AS (SELECT b, count(*) AS t FROM g JOIN k USING (f) GROUP BY b),
n AS (SELECT (SELECT count(*) FROM f) AS s_all, (SELECT count(*) FROM g) AS t_all),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN m USING (b), n),
w AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM fb JOIN gain USING (b) GROUP BY r),
o AS (SELECT d.r, doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (r)),
q AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS i, count(*) OVER () AS n FROM o WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN i <= 5 * n // 100 THEN i END AS rank FROM o LEFT JOIN q USING (r)
"""
