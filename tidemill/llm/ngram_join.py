"""N-gram Jaccard join by prefixes in several global orders.

A document's set is that of its k-word shingles. In any order of all shingles, two sets with a Jaccard similarity of at
least t share one of the first n - ceil(t * n) + 1 of their n elements. Here there are ORDERS orders, all of which put
rare shingles first (by counts over the whole corpus, in BUCKETS hashed buckets) and differ among equally rare ones.
Candidates share a prefix element in each order: pairs of each order are intersected before any set is compared.

Sets that share elements are dealt as groups, and equal groups become pairs once: near copies share most of their elements,
and pairs for each of these would be as many as elements times sets. An element that more than LOCAL sets of a chunk or GROUP of all share in a prefix is hot: it gives no pairs but links to
its least set, in each chunk and then over chunks, so its rows are few when they meet. `pairs` compares candidates, and
sets that hot elements connect are first screened by the same prefixes, in every order.

Equal sets are one item from the start, by 128-bit hashes; shingles and the items among candidates, which are few of
all, are known by 64 bits. Empty sets link with nothing.
Nulls: a null text is empty; a null doc_id is a document, and alone its own component (null).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import marked, marks, stored, table
from tidemill.llm.pairs import item_sets, of_items, similar_components
from tidemill.llm.shingles import mixed, set_id, shingle_set

ORDERS, BUCKETS, PARTS, GROUP, LOCAL, SALTS = 2, 1 << 22, 16, 32, 8, 16
CHUNK_ROWS = 2000
#: TOKEN rows go in parts of about PART_ROWS, dealt to DEALT buckets; a task sorts a bucket at a time (a few 10^4 rows a GB).
DEALT, PART_ROWS = 4096, 1 << 17
#: Counts of a set's sketch.
SKETCH = 64
#: Added to a row's size: it stands for more rows with its token.
STANDS = 1 << 30
#: In place of a size: a link, a counted item, and one counted already.
LINK, COUNTED, SEVERAL = -1, -2, -3


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def sketch(s: np.ndarray) -> bytes:
    """How many of a set's values fall in each of SKETCH classes; 255: so many or more."""
    return np.minimum(np.bincount((s >> np.uint64(32)).astype(np.int64) % SKETCH, minlength=SKETCH), 255).astype(np.uint8).tobytes()


def may_be_similar(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, hot) hot ones, and those whose sketches allow the similarity: two sets share no more values of a class
    than the one with fewer of them has. known: item, n, sketch. Most others' texts and sets are never shuffled then."""
    cold = pairs.where("NOT hot").select("a", "b")
    met = stored(cold.select(F.explode(F.array("a", "b")).alias("item")).distinct(), "join-met")
    own = stored(of_items(known, met).groupBy("item").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "join-sketches")
    side = lambda x: own.select(F.col("item").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"of_{x}")).hint("merge")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("of_a", "of_b"))
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            most = np.minimum(a, b).sum(axis=1, dtype=np.int64)
            may = (100 * most >= percent * (n - most)) | ((a == 255) & (b == 255)).any(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(may))

    kept = cold.join(side("b"), "b").join(side("a"), "a").mapInArrow(tasks, "a long, b long")
    return kept.withColumn("hot", F.lit(False)).unionByName(pairs.where("hot"))


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, h (the text's hash), n, item and more (the set's 128 bits) and sketch of each row; and rows with part and counts (of a bucket range), task by task."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint32)
        names = ["doc_id", "h", "n", "item", "more", "sketch", "part", "counts"]
        for batch in batches:
            sizes, items, sketches = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), k)
                sizes.append(len(s))
                items.append(set_id(s))
                sketches.append(sketch(s))
                counts[(s % np.uint64(BUCKETS)).astype(np.int64)] += 1  # two shingles of a text in one bucket count once
            empty = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *[pa.array([x[j] for x in items], pa.int64()) for j in (0, 1)], pa.array(sketches, pa.binary()), empty.cast(pa.int32()), empty.cast(pa.binary())], names=names)
        data = [zlib.compress(c.tobytes(), 1) for c in counts.reshape(PARTS, -1)]
        none = pa.nulls(PARTS, pa.int64())
        yield pa.RecordBatch.from_arrays([none] * 5 + [pa.nulls(PARTS, pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array(data, pa.binary())], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")), F.col("text").cast("string"))
    return rows.mapInArrow(tasks, "doc_id long, h long, n long, item long, more long, sketch binary, part int, counts binary")


def rarity(counted: DataFrame) -> np.ndarray:
    """The class of each bucket: twice the binary logarithm of its count. Counts are added up in two steps."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(zlib.decompress(data.as_py()), np.uint32).astype(np.uint64)
                sums[part] = sums[part] + own if part in sums else own
        for part, s in sums.items():
            s = np.minimum(s, 2**32 - 1).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(s.tobytes(), 1)], pa.binary())], names=["part", "counts"])

    rows = counted.select("part", "counts").withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(SALTS)))
    half = rows.repartition("part", "salt").select("part", "counts").mapInArrow(total, "part int, counts binary")
    full = half.repartition("part").mapInArrow(total, "part int, counts binary").collect()
    out = np.zeros((PARTS, BUCKETS // PARTS), np.uint8)
    for r in full:
        out[r.part] = np.log2(np.maximum(np.frombuffer(zlib.decompress(r.counts), np.uint32), 1)) * 2
    return out.reshape(-1)


def prefix_tokens(s: np.ndarray, classes: np.ndarray, percent: int) -> list[np.ndarray]:
    """A sorted set's prefix in each order; a token's last bits tell the order."""
    p = prefix_length(len(s), percent)
    of_class = classes[(s % np.uint64(BUCKETS)).astype(np.int64)]
    out = []
    for o in range(ORDERS):
        own = mixed(s, o + 1)
        out.append((own[np.lexsort((own, of_class))[:p]] & np.uint64(2**64 - ORDERS) | np.uint64(o)).view(np.int64))
    return out


TOKEN = "token long, item long, n int"


def thinned(token: np.ndarray, item: np.ndarray, n: np.ndarray, most: int) -> pa.RecordBatch:
    """TOKEN rows of a chunk. Of a token with more than `most` items only the least goes on, and stands for them; each of
    the others is a row with n = LINK, which links it to that one (in token's place)."""
    order = np.argsort(token)
    token, item, n = token[order], item[order], n[order]
    same = token[1:] == token[:-1]
    shared = np.append(False, same) | np.append(same, False) if len(token) else np.zeros(0, bool)
    out = [(token[~shared], item[~shared], n[~shared])]
    if shared.any():
        token, item, n = token[shared], item[shared], n[shared]
        order = np.lexsort((item, token))
        token, item, n = token[order], item[order], n[order]
        new = np.append(True, (token[1:] != token[:-1]) | (item[1:] != item[:-1]))
        token, item, n = token[new], item[new], n[new]
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        sizes = np.diff(np.append(starts, len(token)))
        hot, first = np.repeat(sizes > most, sizes), np.zeros(len(token), bool)
        first[starts] = True
        keep = ~hot | first
        out.append((token[keep], item[keep], np.where(hot, n + STANDS, n)[keep].astype(np.int32)))
        to, own = np.repeat(item[starts], sizes)[hot & ~first], item[hot & ~first]
        order = np.lexsort((own, to))
        to, own = to[order], own[order]
        new = np.append(True, (to[1:] != to[:-1]) | (own[1:] != own[:-1]))[: len(to)]
        out.append((to[new], own[new], np.full(new.sum(), LINK, np.int32)))
    columns = [np.concatenate(c) for c in zip(*out)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "item", "n"])


def prefixes(docs: DataFrame, rare, k: int, percent: int, local: int = LOCAL) -> DataFrame:
    """DEALT_ROWS: each set's prefix in each order. rare: rarity(), broadcast (BUCKETS bytes)."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK_ROWS):
                tokens, items, sizes, seen = [], [], [], set()
                for text in batch.column(0).slice(i, CHUNK_ROWS):
                    s = shingle_set(text.as_py(), k)
                    item = set_id(s)[0]
                    if not len(s) or item in seen:
                        continue
                    seen.add(item)
                    own = np.concatenate(prefix_tokens(s, rare.value, percent))
                    tokens.append(own)
                    items.append(np.full(len(own), item, np.int64))
                    sizes.append(np.full(len(own), len(s), np.int32))
                if tokens:
                    yield thinned(*(np.concatenate(x) for x in (tokens, items, sizes)), local)

    return docs.select(F.col("text").cast("string")).mapInArrow(lambda batches: dealt(tasks(batches)), DEALT_ROWS)


def tallied(item: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """TOKEN rows that count a chunk's items by all their 128 bits (the rest in token's place): n is COUNTED, or SEVERAL if
    the chunk has several."""
    order = np.lexsort((item, more))
    item, more = item[order], more[order]
    starts = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (more[1:] != more[:-1]))[: len(item)])
    n = np.where(np.diff(np.append(starts, len(item))) > 1, SEVERAL, COUNTED).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(more[starts]), pa.array(item[starts]), pa.array(n)], names=["token", "item", "n"])


DEALT_ROWS = "bucket int, rows binary"


def dealt(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """DEALT_ROWS of a task's TOKEN rows: those of a bucket in one piece, which costs a shuffle less than so many rows.
    Links meet nothing, and go by their own items."""
    held, count = [], 0

    def out() -> pa.RecordBatch:
        token, item, n = (np.concatenate(c) for c in zip(*held))
        bucket = ((np.where(n == LINK, item, token) >> 4) & (DEALT - 1)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        token, item, n, bucket = token[order], item[order], n[order], bucket[order]
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
        ends = np.append(starts[1:], len(bucket))
        data = [token[a:b].tobytes() + item[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "rows"])

    for part in parts:
        held.append([c.to_numpy() for c in part.columns])
        count += part.num_rows
        if count >= PART_ROWS:
            yield out()
            held, count = [], 0
    if count:
        yield out()


def undealt(pieces: list[bytes]) -> list[np.ndarray]:
    """token, item and n of a bucket's pieces, sorted by token."""
    columns = zip(*((np.frombuffer(d, np.int64, r), np.frombuffer(d, np.int64, r, 8 * r), np.frombuffer(d, np.int32, r, 16 * r)) for d in pieces for r in [len(d) // 20]))
    token, item, n = (np.concatenate(c) for c in columns)
    order = np.argsort(token)
    return [token[order], item[order], n[order]]


def ungrouped(data: bytes) -> list[np.ndarray]:
    """A piece of together(): groups' counts, orders, items and sizes, then links' two ends and counted items' two halves."""
    g, m, k, t = np.frombuffer(data, np.int32, 4).tolist()
    out, at = [], 16
    for kind, length in ((np.int32, g), (np.int32, g), (np.int64, m), (np.int32, m), (np.int64, k), (np.int64, k), (np.int64, t), (np.int64, t)):
        out.append(np.frombuffer(data, kind, length, at))
        at += out[-1].nbytes
    return out


def together(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """DEALT_ROWS of a task's groups (count, order, item, n), links and counted items: groups go by their least item, so that
    those of the same items, which similar sets have by the dozen, meet before they become pairs; links by their other end."""
    held, count = [], 0
    deal = lambda item: (mixed(item.view(np.uint64), 61) & np.uint64(DEALT - 1)).astype(np.int64)

    def out() -> pa.RecordBatch:
        counts, orders, item, n, a, b, i, rest = (np.concatenate(c) for c in zip(*held))
        starts = np.cumsum(counts) - counts
        by = deal(np.minimum.reduceat(item, starts)) if len(counts) else np.zeros(0, np.int64)
        order = np.argsort(by, kind="stable")
        by, counts, orders, starts = by[order], counts[order], orders[order], starts[order]
        at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(item))
        item, n, ends = item[at], n[at], np.append(0, np.cumsum(counts))
        order = np.lexsort((a, b))
        a, b = a[order], b[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        a, b = a[new], b[new]
        order = np.argsort(deal(b), kind="stable")
        a, b = a[order], b[order]
        order = np.argsort(deal(i), kind="stable")
        i, rest = i[order], rest[order]
        buckets = np.unique(np.concatenate((by, deal(b), deal(i))))
        cuts = [np.searchsorted(x, np.append(buckets, DEALT)) for x in (by, deal(b), deal(i))]
        data = []
        for (g0, g1), (b0, b1), (i0, i1) in zip(*(zip(c[:-1].tolist(), c[1:].tolist()) for c in cuts)):
            m = slice(ends[g0], ends[g1])
            head = np.array([g1 - g0, ends[g1] - ends[g0], b1 - b0, i1 - i0], np.int32)
            data.append(b"".join(x.tobytes() for x in (head, counts[g0:g1], orders[g0:g1], item[m], n[m], a[b0:b1], b[b0:b1], i[i0:i1], rest[i0:i1])))
        return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "rows"])

    for part in parts:
        held.append(part)
        count += sum(len(part[c]) for c in (2, 4, 6))
        if count >= PART_ROWS:
            yield out()
            held, count = [], 0
    if count:
        yield out()


def distinct_groups(counts: np.ndarray, orders: np.ndarray, item: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each distinct group once, with the orders of all that are like it."""
    starts = np.cumsum(counts) - counts
    name = np.add.reduceat(mixed(item.view(np.uint64), 62), starts)
    order = np.lexsort((counts, name))
    first = np.flatnonzero(np.append(True, (name[order][1:] != name[order][:-1]) | (counts[order][1:] != counts[order][:-1])))
    orders, kept = np.bitwise_or.reduceat(orders[order], first), order[first]
    starts, counts = starts[kept], counts[kept]
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return counts, orders, item[at], n[at]


def candidates(tokens: DataFrame, percent: int, orders: int = ORDERS, group: int = GROUP) -> DataFrame:
    """(a, b, hot) from TOKEN or DEALT_ROWS: items that share a token in every order (orders 1: any token), and the links of hot
    tokens. Counted items that there are several of come too, with hot null: a is the item, b its rest."""
    every = (1 << orders) - 1
    key = tokens.columns[0]
    rows = tokens.repartition(key).sortWithinPartitions(key)

    def groups(token: np.ndarray, item: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
        """What together() takes, of rows of whole tokens, sorted by token."""
        same = token[1:] == token[:-1]
        shared = (np.append(False, same) | np.append(same, False) | (n == LINK) | (n == SEVERAL))[: len(token)]
        token, item, n = token[shared], item[shared], n[shared]
        order = np.lexsort((item, n, token))
        token, item, n = token[order], item[order], n[order]
        link, counted = n == LINK, n <= COUNTED
        ends = [(np.minimum(token[link], item[link]), np.maximum(token[link], item[link]))]
        t, i, several = token[counted], item[counted], n[counted] == SEVERAL
        order = np.lexsort((several, i, t))  # of equal ones the last tells if the chunks had several
        t, i, several = t[order], i[order], several[order]
        again = np.append(False, (t[1:] == t[:-1]) & (i[1:] == i[:-1]))[: len(t)] | several
        token, item, n = token[n >= 0], item[n >= 0], n[n >= 0].astype(np.int64)
        stands, n = n >= STANDS, n % STANDS
        counts, masks = np.zeros(0, np.int32), np.zeros(0, np.int32)
        if len(token):
            new = np.append(True, (token[1:] != token[:-1]) | (item[1:] != item[:-1]))
            token, item, n, stands = token[new], item[new], n[new], stands[new]
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            sizes = np.diff(np.append(starts, len(token)))
            large = np.repeat((sizes > group) | np.logical_or.reduceat(stands, starts), sizes)
            least = np.repeat(np.minimum.reduceat(item, starts), sizes)
            ends.append((least[large], item[large]))
            token, item, n = token[~large], item[~large], n[~large]
            # sizes rise in a token's rows: where a step is too large for two neighbours, so it is for all before and after
            new = np.append(True, (token[1:] != token[:-1]) | (100 * n[:-1] < percent * n[1:]))[: len(token)]
            sizes = np.diff(np.append(np.flatnonzero(new), len(token)))
            keep = np.repeat(sizes > 1, sizes)
            mask = 1 << (token % orders) if orders > 1 else np.ones(len(token), np.int64)
            masks, counts = mask[new][sizes > 1].astype(np.int32), sizes[sizes > 1].astype(np.int32)
            item, n = item[keep], n[keep]
        a, b = (np.concatenate(x) for x in zip(*ends))
        yield counts, masks, item, n.astype(np.int32), a[a != b], b[a != b], i[again], t[again]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            own = [c.to_numpy() for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, own)] if held else own
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
            if cut > 100_000:
                yield from groups(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
            elif len(held[0]) - cut > 1_000_000:  # a hot token: its least item so far stands for what has come
                yield from groups(*held)
                at = cut + int(held[1][cut:].argmin())
                held = [held[0][at : at + 1], held[1][at : at + 1], np.array([STANDS], np.int32)]
        if held and len(held[0]):
            yield from groups(*held)

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
        held, now = [], None
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and bucket != now:
                    yield held
                    held = []
                now = bucket
                held.append(data.as_py())
        if held:
            yield held

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for held in by_bucket(batches):
            yield from groups(*undealt(held))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_bucket(batches):
            counts, masks, item, n, a, b, i, rest = (np.concatenate(c) for c in zip(*map(ungrouped, held)))
            out = [(a, b, np.full(len(a), every), np.full(len(a), 1)), (i, rest, np.full(len(i), every), np.full(len(i), -1))]
            if len(counts):
                counts, masks, item, n = distinct_groups(counts, masks, item, n)
                of, mask, n = np.repeat(np.arange(len(counts)), counts), np.repeat(masks, counts), n.astype(np.int64)
                for d in range(1, int(counts.max())):
                    same = np.flatnonzero(of[d:] == of[:-d])
                    same = same[100 * n[same] >= percent * n[same + d]]
                    out.append((np.minimum(item[same], item[same + d]), np.maximum(item[same], item[same + d]), mask[same], np.zeros(len(same), np.int64)))
            a, b, m, hot = (np.concatenate(x) for x in zip(*out))
            order = np.lexsort((hot < 0, b, a))
            a, b, m, hot = a[order], b[order], m[order], hot[order]
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | ((hot[1:] < 0) != (hot[:-1] < 0)))[: len(a)])
            if len(first):
                a, b, m, hot = a[first], b[first], np.bitwise_or.reduceat(m, first), np.maximum.reduceat(hot, first)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(m.astype(np.int32)), pa.array(hot > 0, mask=hot < 0)], names=["a", "b", "mask", "hot"])

    own = buckets if key == "bucket" else tasks
    met = rows.mapInArrow(lambda batches: together(own(batches)), DEALT_ROWS).repartition("bucket").sortWithinPartitions("bucket")
    found = met.mapInArrow(pairs, "a long, b long, mask int, hot boolean")
    found = found.groupBy("a", "b", F.col("hot").isNull().alias("tally")).agg(F.bit_or("mask").alias("mask"), F.bool_or("hot").alias("hot"))
    return found.where(F.col("mask") == every).select("a", "b", "hot")


def joined(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, h, n_shingles, component_id (the least doc_id that links lead to) of each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = stored(profiles(docs, k), "join-profiles")
    known = rows.where("part IS NULL").drop("part", "counts", "sketch")
    rare = docs.sparkSession.sparkContext.broadcast(rarity(rows.where("part IS NOT NULL")))
    found = stored(candidates(prefixes(docs, rare, k, percent), percent), "join-candidates")
    found = stored(may_be_similar(found, rows.where("n > 0").select("item", "n", "sketch"), percent), "join-similar")
    filled = known.where("n > 0")
    met = found.select(F.explode(F.array("a", "b")).alias("item")).distinct()
    items = filled.join(met, "item").groupBy("item").agg(F.min_by(F.struct("doc_id", "h"), F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("at"))
    items = stored(items.select("item", "at.doc_id", "at.h", F.lit(0).alias("start"), F.lit(-1).alias("length")), "join-items")
    sets = stored(item_sets(items, docs, k), "join-sets")
    groups = similar_components(found, sets, percent, lambda s: prefix_tokens(s, rare.value, percent))
    grouped = filled.join(groups.hint("merge"), filled["item"] == groups["node"], "left")
    grouped = grouped.select("doc_id", "h", "n", F.coalesce("component", "item").alias("c"), F.when(F.col("component").isNull(), F.col("more")).otherwise(0).alias("more"))
    least = stored(grouped.groupBy("c", "more").agg(F.min("doc_id").alias("component_id")), "join-least")
    out = grouped.join(least.hint("merge"), ["c", "more"]).select("doc_id", "h", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(known.where("n = 0").select("doc_id", "h", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: 3-word shingles, similarity 0.9."""
    return joined(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90).select("doc_id", "n_shingles", "component_id")


def kept_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without those rows whose component has a row with a smaller doc_id, and each row once. Rows with a null doc_id
    stay if no row of their component has an id."""
    rows = stored(joined(docs, k, percent), "join-rows")
    keeps = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = rows.where(keeps).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct().hint("merge")
    # only documents that may have to go meet the others; the rest passes by
    own = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("doc_id"))
    again = rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    own = marked(own, marks(rows.where(~keeps).select("doc_id").unionByName(again), "join-marks"))
    some = own.where("marked").withColumn("__hash", F.xxhash64(F.col("__row.text").cast("string")))
    stay = some.join(first, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")), "left_semi")
    return own.where("NOT marked").select("__row.*").unionByName(stay.dropDuplicates(["doc_id", "__hash"]).select("__row.*"))
