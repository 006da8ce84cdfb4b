"""Substring dedup by paragraphs.

A text's lines are its paragraphs, and the sentences of a line that has several are paragraphs of a finer cut, so that
near copies inside longer lines are met too. Each of LEAST words or more gets a MinHash signature of its 5-word
shingles, in as many bands as tuned() finds for the recall wanted; those that collide in a band are compared exactly
(Jaccard similarity of at least 80 percent), and what is similar, or similar to similar ones, is a class. Lines meet
lines and sentences meet sentences, so that no line meets its own; a line of one sentence is both. Sets of under
LEAST_BANDED shingles can only be similar if they are equal, and need no bands. Paragraphs of fewer words than a shingle
has are phrases, and stay; `least_words` sets another bound.

For passages that keep to no such boundaries there are windows of WINDOW words, placed by content: at the least shingle
of each STEP successive ones, so that any run of WINDOW + STEP - 1 words that texts share has a window that they share.
Windows, paragraphs too, are in one class if their words are equal. Of a longer run at most STEP - 1 words at each end
are left, if no paragraph there goes by itself.

Of each class the first unit (by doc_id and place) stays, and the others go from their texts, but for those that overlap
the first. Equal units are one item from the start, so groups of copies cost little. A null text is empty; a null doc_id
comes after all others; repeated rows (same id and text) share one decision, and so do not remove each other.

Units are cut from many texts at once, and never stored but for those that have a counterpart: a first pass gives bands
and counts items (128-bit hashes), a second one the units of items that repeat or have candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import MARK_BITS, filter_bits, marked, marks, stored, table
from tidemill.llm.ngram_join import DEALT_ROWS, LOCAL, candidates, dealt, tallied, thinned
from tidemill.llm.pairs import item_sets, similar_components
from tidemill.llm.shingles import mixed, shingles, word_hashes

K, PERCENT, RECALL, MOST_HASHES, LEAST = 5, 80, 0.995, 24, 5
WINDOW, STEP = 16, 12
#: n / (n + 1) is the most that unequal sets reach of which the smaller has n.
LEAST_BANDED = PERCENT // (100 - PERCENT)
CHUNK_BYTES = 1 << 20


def tuned(threshold: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): of those that find pairs at the threshold with the recall, the one with the most rows in a band."""
    for rows in range(most, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no bands reach the recall with so few hashes")


BANDS, ROWS = tuned(PERCENT / 100)
_XOR = mixed(np.arange(BANDS * ROWS, dtype=np.uint64), 31)
_TIMES = mixed(np.arange(BANDS * ROWS, dtype=np.uint64), 32) | np.uint64(1)


class Units(NamedTuple):
    """Units of some texts: arrays by unit, and of the shingles of all texts end to end."""

    text: np.ndarray
    start: np.ndarray  # in bytes of the text
    length: np.ndarray
    item: np.ndarray  # 128 bits, as two signed numbers
    more: np.ndarray
    window: np.ndarray  # whether it is one
    line: np.ndarray
    sentence: np.ndarray
    first: np.ndarray  # shingles of it, from first to before last; first = last: under K words
    last: np.ndarray
    grams: np.ndarray


def anchors(order: np.ndarray, step: int = STEP) -> np.ndarray:
    """For each `step` successive values the place of the least (the first of equal ones)."""
    if len(order) < step:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(order, step).argmin(axis=1) + np.arange(len(order) - step + 1)


def placed_windows(grams: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """First words of the windows. Of windows with equal words that overlap in a chain, one in WINDOW words is taken."""
    at = anchors(mixed(grams, 1))
    own = np.arange(len(at))
    at = np.unique(at[text_of[own] == text_of[own + STEP + K - 2]])  # what the least is taken of lies in one text
    at = at[at + WINDOW <= len(text_of)]
    at = at[text_of[at] == text_of[at + WINDOW - 1]]
    if len(at) < 2:
        return at
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed(grams, 22))))
    key = sums[at + WINDOW - K + 1] - sums[at]
    by = np.lexsort((at, key))
    place, key = at[by], key[by]
    new = np.append(True, (key[1:] != key[:-1]) | (place[1:] - place[:-1] >= WINDOW))
    turn = (place - place[new][np.cumsum(new) - 1]) // WINDOW
    return np.sort(place[new | np.append(True, turn[1:] != turn[:-1])])


def units(raws: list[bytes], least_words: int = LEAST) -> Units:
    """The units of texts with a word, text by text: lines, then sentences of lines with several, then windows."""
    joined = b"\n".join(raws)
    letters = np.frombuffer(joined, np.uint8)
    inside = np.concatenate(([False], (letters != 32) & ((letters < 9) | (letters > 13)), [False]))
    first_byte, last_byte = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    hashes = word_hashes(joined.lower().split())
    n = len(hashes)
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    text_words = np.append(np.searchsorted(first_byte, begins), n)
    text_of = np.repeat(np.arange(len(raws)), np.diff(text_words))
    line_bytes = np.append(np.concatenate(([0], np.flatnonzero(letters == 10) + 1)), len(joined) + 1)
    line_words = np.append(np.searchsorted(first_byte, line_bytes[:-1]), n)
    line_of = np.repeat(np.arange(len(line_words) - 1), np.diff(line_words))
    full = np.unique(line_words)
    stops = (letters[last_byte - 1] == 33) | (letters[last_byte - 1] == 46) | (letters[last_byte - 1] == 63)
    cuts = np.unique(np.concatenate((full, np.flatnonzero(stops) + 1))) if n else full
    sentences = np.stack([cuts[:-1], cuts[1:]])
    whole = np.isin(sentences[0], full) & np.isin(sentences[1], full)
    single = np.isin(full[:-1], sentences[0][whole])
    sentences = sentences[:, ~whole]
    grams = shingles(hashes, K) if n >= K else np.zeros(0, np.uint64)
    at = placed_windows(grams, text_of)
    a = np.concatenate((full[:-1], sentences[0], at))
    b = np.concatenate((full[1:], sentences[1], at + WINDOW))
    line = np.arange(len(a)) < len(single)
    sentence = np.concatenate((single, np.ones(sentences.shape[1], bool), np.zeros(len(at), bool)))
    keep = b - a >= least_words
    a, b, line, sentence = a[keep], b[keep], line[keep], sentence[keep]
    first, last = np.minimum(a, len(grams)), np.maximum(np.minimum(a, len(grams)), b - K + 1)
    ids = []
    for seed in (21, 22):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed(grams, seed))))
        own = sums[last] - sums[first]
        for width in range(1, K):
            few = np.flatnonzero(b - a == width)
            if len(few):
                own[few] = mixed(shingles(hashes, width), seed)[a[few]]
        ids.append(mixed(own, seed).view(np.int64))
    # a unit goes with the white space up to the next word of its line, or with the rest of the line
    own_line, end_line = line_of[a] if n else a, line_of[b - 1] if n else a
    start = np.where(a == line_words[own_line], line_bytes[own_line], first_byte[a] if n else a)
    following = np.append(first_byte, len(joined))[b] if n else b
    end = np.where(b == line_words[end_line + 1], line_bytes[end_line + 1] - 1, following) if n else b
    text = text_of[a] if n else a
    return Units(text, start - begins[text], end - start, *ids, ~line & ~sentence, line, sentence, first, last, grams)


def band_keys(u: Units) -> tuple[np.ndarray, np.ndarray]:
    """(token, unit): the keys of the units that are banded."""
    own = np.flatnonzero(~u.window & (u.last - u.first >= LEAST_BANDED))
    if not len(own):
        return np.zeros(0, np.int64), own
    ranges = np.stack([u.first[own], u.last[own]], axis=1).ravel()
    kinds = [np.flatnonzero(k[own]) for k in (u.line, u.sentence)]
    key, keys = None, []
    for i, (x, t) in enumerate(zip(_XOR, _TIMES)):
        order = np.append((u.grams ^ x) * t, ~np.uint64(0))
        least = np.minimum.reduceat(order, ranges)[::2]
        key = mixed((np.full(len(own), np.uint64(i)) if i % ROWS == 0 else key) ^ least, i)
        if i % ROWS == ROWS - 1:
            keys += [mixed(key[k], 40 + kind).view(np.int64) for kind, k in enumerate(kinds)]
    return np.concatenate(keys), np.tile(own[np.concatenate(kinds)], BANDS)


def chunks(batch: pa.RecordBatch, least_words: int) -> Iterator[tuple[int, Units]]:
    """(first row, units) of about CHUNK_BYTES of text, the last column. One text is never cut."""
    raws, size, first = [], 0, 0
    for row, text in enumerate(batch.column(batch.num_columns - 1)):
        raws.append((text.as_py() or "").encode())
        size += len(raws[-1])
        if size >= CHUNK_BYTES or row == batch.num_rows - 1:
            yield first, units(raws, least_words)
            raws, size, first = [], 0, row + 1


def bands(docs: DataFrame, least_words: int = LEAST, local: int = LOCAL) -> DataFrame:
    """DEALT_ROWS: the band keys of the units that are banded (sizes are left to the comparison), and counts of all units' items."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, u in chunks(batch, least_words):
                token, unit = band_keys(u)
                yield thinned(token, u.item[unit], np.ones(len(token), np.int32), local)
                yield tallied(u.item, u.more)

    return docs.select(F.col("text").cast("string")).mapInArrow(lambda batches: dealt(tasks(batches)), DEALT_ROWS)


FOUND = "item long, more long, doc_id long, h long, start int, length int, window boolean"


def found_units(docs: DataFrame, wanted: DataFrame, least_words: int = LEAST) -> DataFrame:
    """FOUND rows, one for each unit that may be of the wanted items: where it lies (h: the text's hash)."""
    bits = docs.sparkSession.sparkContext.broadcast(filter_bits(wanted))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FOUND.split(", ")]
        for batch in batches:
            for first, u in chunks(batch, least_words):
                at = u.item & (MARK_BITS - 1)
                own = np.flatnonzero(bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                row = pa.array(u.text[own] + first)
                columns = [pa.array(u.item[own]), pa.array(u.more[own]), batch.column(0).take(row), batch.column(1).take(row), pa.array(u.start[own].astype(np.int32)), pa.array(u.length[own].astype(np.int32)), pa.array(u.window[own])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")), F.col("text").cast("string"))
    return rows.mapInArrow(tasks, FOUND)


def classes(docs: DataFrame, least_words: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(units of classes of several: class, more_class, doc_id, h, start, length; the first unit of each class)."""
    met = stored(candidates(bands(docs, least_words), 0, orders=1), "dedup-candidates")
    items, pairs = met.where("hot IS NULL").select(F.col("a").alias("item"), F.col("b").alias("more")), met.where("hot IS NOT NULL")
    in_pairs = stored(pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct(), "dedup-in-pairs")
    found = stored(found_units(docs, items.select("item").unionByName(in_pairs), least_words), "dedup-units")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "h", "start", "length")
    paired = found.where("NOT window").join(in_pairs.hint("merge"), "item").groupBy("item").agg(F.min(place).alias("first"))
    sets = stored(item_sets(paired.select("item", "first.doc_id", "first.h", "first.start", "first.length"), docs, K), "dedup-sets")
    groups = similar_components(pairs, sets, PERCENT).select(F.col("node").alias("item"), F.col("component").alias("class"))
    # an item that is in a class, or that repeats; the latter by all its 128 bits
    known = groups.join(items.hint("merge"), "item", "full").select("item", F.coalesce("class", "item").alias("class"), F.when(F.col("class").isNull(), F.col("more")).alias("again"))
    known = stored(known.distinct(), "dedup-known")
    several = found.join(known.hint("merge"), "item").where("again IS NULL OR again = more")
    several = stored(several.select("class", F.coalesce("again", F.lit(0)).alias("more_class"), "doc_id", "h", "start", "length"), "dedup-several")
    return several, stored(several.groupBy("class", "more_class").agg(F.min(place).alias("first")), "dedup-classes")


def removals(docs: DataFrame, least_words: int = LEAST) -> DataFrame:
    """doc_id, h, and spans (start, end in bytes, first_doc_id that keeps what they hold) to remove."""
    several, firsts = classes(docs, least_words)
    hit = several.join(firsts.hint("merge"), ["class", "more_class"])
    same = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("h") == F.col("first.h"))
    over = (F.col("start") < F.col("first.start") + F.col("first.length")) & (F.col("first.start") < F.col("start") + F.col("length"))
    span = F.struct("start", (F.col("start") + F.col("length")).alias("end"), F.col("first.doc_id").alias("first_doc_id"))
    return hit.where(~(same & over)).groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(span)).alias("spans"))


SCHEMA = "n_bytes long, n_removed long, n_spans long, kept_with array<long>, text string"


def cut(raw: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """What is left, the bytes removed, and in how many runs. A line that goes takes its newline along."""
    runs: list[list[int]] = []
    for s in spans:
        if runs and s["start"] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], s["end"])
        else:
            runs.append([s["start"], s["end"]])
    left, at, gone = [], 0, 0
    for a, b in runs:
        if (a == 0 or raw[a - 1 : a] == b"\n") and raw[b : b + 1] == b"\n":
            b += 1
        a = max(a, at)
        left.append(raw[at:a])
        gone += max(0, b - a)
        at = max(at, b)
    left.append(raw[at:])
    return b"".join(left), gone, len(runs)


def _marked(rows: DataFrame, bits: DataFrame) -> DataFrame:
    own = marked(rows.select(F.struct("*").alias("__row"), F.col("__key").alias("doc_id")), bits)
    return own.select("__row.*", F.col("marked").alias("__marked"))


def deduplicated(docs: DataFrame, least_words: int = LEAST) -> DataFrame:
    """docs with n_bytes (before), n_removed, n_spans, kept_with (ids of the documents that keep what is removed here) and the text that is left."""
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept_with", "text")]
    gone = stored(removals(docs, least_words), "dedup-removals")
    touched = gone.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("spans").alias("__spans")).hint("merge")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("doc_id").cast("long").alias("__key"), F.col("text").cast("string").alias("__text"))
    rows = _marked(rows, marks(gone, "dedup-marks"))
    met = rows.where("__marked").withColumn("__hash", F.xxhash64("__text")).join(touched, (F.col("__hash") == F.col("__h")) & F.col("__key").eqNullSafe(F.col("__id")), "left")
    names = [*[F.col(f"`{c}`") for c in keep], "__spans", "__text"]
    clean = rows.where("NOT __marked").withColumn("__spans", F.lit(None).cast(gone.schema["spans"].dataType))
    rows = met.select(*names).unionByName(clean.select(*names))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
        for batch in batches:
            out = []
            for spans, text in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()):
                raw = (text or "").encode()
                left, n, runs = cut(raw, spans or [])
                firsts = sorted({s["first_doc_id"] for s in spans or [] if s["first_doc_id"] is not None})
                out.append((len(raw), n, runs, firsts, text if not spans else left.decode()))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c, t) for c, t in zip(cols, types)]], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept_with", "text"])

    schema = T.StructType([*rows.drop("__spans", "__text").schema, *T.StructType.fromDDL(SCHEMA)])
    return rows.mapInArrow(tasks, schema)


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: bytes before, bytes and runs removed, which documents keep them, and a digest of what is left."""
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_with", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
