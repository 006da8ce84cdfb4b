"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that starts earlier too.

Every start of such a string in a text is known by the least hash of the KGRAM-byte strings within it, so equal
strings have equal keys. Starts that follow each other with one key are a fragment: a key, a place, and so many starts.

1. Tasks cut texts into fragments. Of equal fragments in a chunk of text the first goes on, the others are covered.
2. Fragments meet by key. Of equal ones the first goes on, the others are covered; a key with one fragment is done.
3. What is left, fragments that share a key and differ, is compared as text, many keys to a task. The suffixes of the
   fragments are sorted as deep as needed, and intervals of the Burrows-Wheeler transform are extended backward, breadth
   first: each step finds the suffixes whose common prefix with the one before is one byte longer, and the search stops
   at LENGTH. What then has no value shares LENGTH bytes. Of each such group of starts the first stays.
4. A key with more than HOT fragments, or of more than HOT_BYTES, would not fit a task: there, starts meet by 128-bit
   hashes of their strings, and long fragments are cut in slices that overlap by LENGTH - 1 bytes.

Documents are ordered by doc_id, a null one last, and those with equal ids by their texts' hashes; rows with equal ids
and texts are one document. A null text is empty. Only documents with something covered are shuffled for the result;
which those are is told by bits of hashed ids, whose size is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import marked, marks, stored, table
from tidemill.llm.shingles import mixed

LENGTH, KGRAM = 100, 32
CHUNK_BYTES, BUCKET_BYTES, HOT = 1 << 20, 1 << 20, 4000
HOT_BYTES, SLICE_BYTES, SLICE_STARTS = 4 << 20, 1 << 20, 1 << 16
_BYTE = mixed(np.arange(256, dtype=np.uint64), 77)
_P = 0x9E3779B97F4A7C15


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each `width` neighbours."""
    done = 1
    while done * 2 <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def window_keys(raw: np.ndarray, length: int = LENGTH, k: int = KGRAM) -> tuple[np.ndarray, np.ndarray]:
    """The key of each start, the least hash of the k-byte strings in the `length` bytes from there, and these hashes. k: a power of two."""
    h, width = _BYTE[raw], 1
    while width < k:
        h = h[:-width] * np.uint64(pow(_P, width, 1 << 64)) + h[width:]
        width *= 2
    h = mixed(h, 5)
    return _sliding(h, length - k + 1, np.minimum), h


def fragments(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of texts end to end: text, start in it, number of starts, key, content hash, and loop of each fragment. Without
    loop, no two of its starts have equal strings: its key's string stands in it once."""
    joined = b"".join(texts)
    none = np.zeros(0, np.int64)
    if len(joined) < length:
        return none, none, none, none, none, none > 0
    keys, grams = window_keys(np.frombuffer(joined, np.uint8), length)
    span = length - KGRAM + 1
    ends_of = np.zeros(span - 1, np.uint64)
    least = np.flatnonzero(_sliding(np.concatenate([ends_of, keys, ends_of]), span, np.maximum) == grams)
    twice = np.flatnonzero(grams[least[1:]] == grams[least[:-1]])
    one, other = least[twice], least[twice + 1]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    at = np.flatnonzero(np.arange(len(keys)) + length <= np.repeat(ends, sizes)[: len(keys)])
    if not len(at):
        return none, none, none, none, none, none > 0
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (keys[at[1:]] != keys[at[:-1]])))
    starts, counts = at[first], np.diff(np.append(first, len(at)))
    owner = np.searchsorted(ends, starts, side="right")
    view = memoryview(joined)
    content = np.fromiter((xxhash.xxh3_64_intdigest(view[a : a + n + length - 1]) for a, n in zip(starts.tolist(), counts.tolist())), np.uint64, len(starts))
    loop = np.searchsorted(other, starts + counts - 1 + span - 1, side="right") > np.searchsorted(one, starts)
    return owner, starts - (ends - sizes)[owner], counts, keys[starts].view(np.int64), content.view(np.int64), loop


FRAGMENT = "key long, content long, doc_id long, h long, start int, starts int, covered boolean, loop boolean"
ARROW = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("starts", pa.int32()), ("covered", pa.bool_()), ("loop", pa.bool_())])


def cut(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """FRAGMENT rows of docs (doc_id, h, text); covered: an equal fragment lies earlier in the same chunk."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda i: (ids[i][0] is None, ids[i][0] or 0, ids[i][1]))
            order = [i for n, i in enumerate(order) if not n or ids[i] != ids[order[n - 1]]]
            owner, start, counts, key, content, loop = fragments([texts[i] for i in order], length)
            by = np.lexsort((np.arange(len(key)), content, key))  # places are in order already
            again = np.zeros(len(key), bool)
            again[by[1:]] = (key[by[1:]] == key[by[:-1]]) & (content[by[1:]] == content[by[:-1]])
            docs_, hs = pa.array([ids[i][0] for i in order], pa.int64()), pa.array([ids[i][1] for i in order], pa.int64())
            at = pa.array(owner)
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(content), docs_.take(at), hs.take(at), pa.array(start.astype(np.int32)), pa.array(counts.astype(np.int32)), pa.array(again), pa.array(loop)], schema=ARROW)

        for batch in batches:
            for doc_id, h, text in zip(*batch.columns):
                raw = (text.as_py() or "").encode()
                if len(raw) < length:
                    continue
                ids.append((doc_id.as_py(), h.as_py()))
                texts.append(raw)
                size += len(raw)
                if size >= CHUNK_BYTES:
                    yield flush()
                    size = 0
        if ids:
            yield flush()

    return docs.mapInArrow(tasks, FRAGMENT)


# --- one task's text ------------------------------------------------------------------------------------------------


def sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols at least (0..256), by doubling from packed prefixes of seven."""
    n = len(symbols)
    known = 7
    padded = np.concatenate([symbols, np.zeros(known, symbols.dtype)])
    rank = np.zeros(n, np.int64)
    for i in range(known):
        rank *= 512
        rank += padded[i : n + i]
    order = np.argsort(rank)
    rank = _ranks(rank, order)
    while known < depth and rank[order[-1]] < n - 1:
        del order
        both = rank * (n + 1)
        both[: n - known] += rank[known:] + 1
        del rank
        order = np.argsort(both)
        rank = _ranks(both, order)
        known *= 2
    return order


def _ranks(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rank of each value, equal ones alike. order: sorts them."""
    values = values[order]
    rank = np.empty(len(values), np.int64)
    rank[order] = np.cumsum(np.append(False, values[1:] != values[:-1]))
    return rank


def long_common_prefixes(symbols: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, far): suffixes in order, and whether each shares `length` symbols or more with the one before.

    Common prefixes get their values by increasing size: an interval of suffixes that begin with a string of l symbols is
    extended backward by each symbol that stands before one of them; where the new interval ends without a value, the
    value is l and the interval goes on. After `length` rounds, what has none is long.
    """
    symbols = np.append(symbols.astype(np.int16) + np.int16(1), np.int16(0))  # the end is unlike all else
    n = len(symbols)
    place = np.int32 if n < 1 << 31 else np.int64
    order = sorted_suffixes(symbols, length).astype(place)
    before = symbols[order - 1]  # the transform
    to = np.empty(n, place)
    to[np.argsort(before, kind="stable")] = np.arange(n, dtype=place)
    first = symbols[order]
    valued = np.zeros(n + 1, bool)
    valued[0] = valued[n] = True  # both ends
    low, high = np.array([0], place), np.array([n - 1], place)
    owner = np.empty(n, place)
    for _ in range(length):
        if not len(low):
            break
        sizes = high - low + 1
        at = np.arange(sizes.sum(), dtype=place)
        at -= np.repeat((np.cumsum(sizes) - sizes - low).astype(place), sizes)
        held = to[at]
        del at
        owner[held] = np.repeat(np.arange(len(low), dtype=place), sizes)
        held.sort()
        own = owner[held]
        new = np.append(True, (held[1:] != held[:-1] + 1) | (own[1:] != own[:-1]) | (first[held[1:]] != first[held[:-1]]))
        begin = np.flatnonzero(new)
        low, high = held[begin], held[np.append(begin[1:], len(held)) - 1]
        last = high == n - 1
        go = ~valued[high + 1] | last
        valued[high[go] + 1] = True
        low, high = low[go], high[go]
    return order[1:], ~valued[1:n]


def covered_starts(texts: list[bytes], places: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each text the starts, in order, whose string of `length` bytes also starts at a lesser place. places: of the texts' first bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    symbols = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8).astype(np.int16) + np.int16(1)
    symbols[np.cumsum(sizes + 1) - 1] = 0  # what separates texts
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    order, far = long_common_prefixes(symbols, length)
    shared = far | np.append(far[1:], False)[: len(far)]  # what shares nothing is no group
    order, group = order[shared].astype(np.int64), np.cumsum(~far)[shared]
    text = np.searchsorted(begins, order, side="right") - 1
    offset = order - begins[text]
    whole = offset + length <= sizes[text]
    group, text, offset = group[whole], text[whole], offset[whole]
    place = places[text] + offset
    by = np.lexsort((place, group))
    least = place[by][np.flatnonzero(np.append(True, group[by][1:] != group[by][:-1]))] if len(by) else place
    number = np.cumsum(np.append(True, group[by][1:] != group[by][:-1])) - 1 if len(by) else by
    later = place[by] > least[number] if len(by) else np.zeros(0, bool)
    hit_text, hit_offset = text[by][later], offset[by][later]
    again = np.lexsort((hit_offset, hit_text))
    hit_text, hit_offset = hit_text[again], hit_offset[again]
    edges = np.searchsorted(hit_text, np.arange(len(texts) + 1))
    return [hit_offset[a:b] for a, b in zip(edges, edges[1:])]


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of consecutive starts."""
    if not len(starts):
        return []
    first = np.flatnonzero(np.append(True, starts[1:] != starts[:-1] + 1))
    return list(zip(starts[first].tolist(), np.diff(np.append(first, len(starts))).tolist()))


# --- tables ---------------------------------------------------------------------------------------------------------

COVERED = "doc_id long, h long, start int, starts int"


def compared(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """COVERED rows from parts (bucket, doc_id, h, start, content): fragments' bytes, those of a key in one bucket."""

    def compare(t: pa.Table) -> pa.Table:
        rows = sorted(set(zip(*(t.column(c).to_pylist() for c in ("doc_id", "h", "start", "content")))), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
        number = np.cumsum([i > 0 and rows[i][:2] != rows[i - 1][:2] for i in range(len(rows))]).astype(np.int64)
        places = (number << 40) + np.array([r[2] for r in rows], np.int64)
        out = [(r[0], r[1], r[2] + a, n) for r, s in zip(rows, covered_starts([r[3] for r in rows], places, length)) for a, n in runs(s)]
        return pa.table([pa.array(c, kind) for c, kind in zip(list(zip(*out)) or [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "h", "start", "starts"])

    return parts.groupBy("bucket").applyInArrow(compare, COVERED)


def hashed(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """COVERED rows from parts of keys with very many or very long fragments: by the hash of each start's string."""
    size = F.octet_length("content")
    total = parts.agg(F.sum(size)).first()[0] or 0
    at = F.sequence(F.lit(0), size - length, F.lit(SLICE_BYTES))
    slices = F.transform(at, lambda i: F.struct((F.col("start") + i).alias("start"), F.substring(F.col("content"), i + 1, F.lit(SLICE_BYTES + length - 1)).alias("content")))
    cut_up = parts.select("doc_id", "h", F.explode(slices).alias("s")).select("doc_id", "h", "s.*").repartition(int(total // HOT_BYTES + 1), "doc_id", "h", "start")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, h, start, content in zip(*(c.to_pylist() for c in batch.columns)):
                view, starts = memoryview(content), len(content) - length + 1
                for first in range(0, starts, SLICE_STARTS):
                    n = min(SLICE_STARTS, starts - first)
                    digests = [xxhash.xxh3_128_digest(view[i : i + length]) for i in range(first, first + n)]
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([doc_id] * n, pa.int64()), pa.array([h] * n, pa.int64()), pa.array(range(start + first, start + first + n), pa.int32())], names=["digest", "doc_id", "h", "start"])

    rows = cut_up.select("doc_id", "h", "start", "content").mapInArrow(tasks, "digest binary, doc_id long, h long, start int")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "h", "start")
    least = rows.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = rows.join(least, "digest").where(place > F.col("first"))
    # starts in a row are one row, so that a long text's spans stay few
    found = found.groupBy("doc_id", "h", F.floor(F.col("start") / SLICE_STARTS).alias("slice")).agg(F.sort_array(F.collect_set("start")).alias("starts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(d, h, a, n) for d, h, s in zip(*(c.to_pylist() for c in batch.columns)) for a, n in runs(np.array(s, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*out)) or [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "h", "start", "starts"])

    return found.select("doc_id", "h", "starts").mapInArrow(joined, COVERED)


def covered(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """COVERED rows of docs (doc_id, h, text): starts whose string also starts earlier; some may come twice."""
    rows = stored(cut(docs, length), "suffix-fragments")
    known = rows.where("covered").select("doc_id", "h", "start", "starts")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "h", "start")
    of_key, of_content = Window.partitionBy("key"), Window.partitionBy("key", "content").orderBy("unknown", "doc_id", "h", "start")
    met = rows.where("NOT covered").withColumn("unknown", F.col("doc_id").isNull())
    met = met.withColumn("first", F.first(place).over(of_content)).withColumn("several", F.min("content").over(of_key) != F.max("content").over(of_key))
    met = met.where("several OR loop OR NOT (doc_id <=> first.doc_id AND h = first.h AND start = first.start)")
    met = stored(met.withColumn("equal", place > F.col("first")).select("key", "doc_id", "h", "start", "starts", "equal"), "suffix-met")
    equal = met.where("equal").select("doc_id", "h", "start", "starts")
    differ = met.where("NOT equal")
    counts = differ.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("starts").cast("long") + length).alias("bytes")).where((F.col("n") > HOT) | (F.col("bytes") > HOT_BYTES)).select("key", F.lit(True).alias("hot"))
    counts = stored(counts, "suffix-hot")
    total = differ.agg(F.sum(F.col("starts") + length)).first()[0] or 0
    differ = differ.join(F.broadcast(counts) if counts.count() <= 10_000 else counts, "key", "left")
    wanted = differ.select(F.col("doc_id").alias("w_id"), F.col("h").alias("w_h"), F.col("start"), F.col("starts"), F.coalesce("hot", F.lit(False)).alias("hot"), F.pmod(F.xxhash64("key"), F.lit(total // BUCKET_BYTES + 1)).alias("bucket"))
    some = marked(docs, marks(differ, "suffix-differ-marks")).where("marked")
    parts = some.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h")))
    parts = parts.select("bucket", "hot", "doc_id", "h", "start", F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("starts") + length - 1).alias("content"))
    parts = stored(parts, "suffix-parts")
    return known.unionByName(equal).unionByName(compared(parts.where("NOT hot"), length)).unionByName(hashed(parts.where("hot"), length))


def remaining(raw: bytes, spans: list[tuple[int, int]], length: int = LENGTH) -> tuple[bytes, int, int]:
    """What is left, bytes removed, maximal runs removed. spans: (start, starts), sorted."""
    left, end, gone, count = [], 0, 0, 0
    last = -1
    for start, n in spans:
        a, b = start, start + n - 1 + length
        if a > last:
            left.append(raw[end:a])
            count += 1
            gone += b - a
            last = end = b
        elif b > last:
            gone += b - last
            last = end = b
    left.append(raw[end:])
    return b"".join(left), gone, count


RESULT = "n_bytes long, n_removed long, n_spans long, text binary"


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and text (the bytes left) of each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    unclear = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count()
    docs = docs.select("doc_id", (F.xxhash64("text") if unclear else F.lit(0).cast("long")).alias("h"), "text")
    spans = stored(covered(docs, length), "suffix-covered")
    rows = marked(docs, marks(spans, "suffix-marks"))
    of_doc = spans.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("start", "starts"))).alias("spans"))
    of_doc = of_doc.select(F.col("doc_id").alias("s_id"), F.col("h").alias("s_h"), "spans")
    touched = rows.where("marked").join(of_doc, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left").select("doc_id", "text", "spans")
    clean = rows.where("NOT marked").select("doc_id", "text", F.expr("CAST(NULL AS array<struct<start:int,starts:int>>)").alias("spans"))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode()
                left, gone, count = remaining(raw, [(s["start"], s["starts"]) for s in spans or []], length)
                out.append((len(raw), gone, count, left))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "text"])

    return touched.unionByName(clean).mapInArrow(tasks, "doc_id long, " + RESULT)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: strings of 100 bytes."""
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))
