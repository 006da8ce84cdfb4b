"""From candidate pairs of sets to components of what is similar.

Each set's values are read once. Then, with as few comparisons as connect the same:

1. each item is compared with the least item that it is a candidate with: as many comparisons as items;
2. candidates that are not in one component by then are compared, pair by pair; what hot tokens join (`hot`) stands for
   all pairs of its candidates' component, and one that is in pieces meets LEADERS of its sets, those with the most
   shingles that half of its sets have and the fewest others;
3. of what is in pieces still, sets outside of the largest piece are compared with those that have a shingle of their
   prefix, where what half of the component's sets have comes last, and of a size that what is left of the prefix allows:
   variants that differ enough share none;
4. sets that hang together by prefix shingles of very many are compared in blocks: those outside of the largest piece
   with all that their size allows, each two blocks a task's work.

Steps 1 and 2 are joins, whose skewed keys are split by adaptive execution; a task of step 4 has two blocks, whatever the
component's size. A block's links are thinned to as many as connect its sets. A join shuffles only the sets that it needs,
as bits of their items tell, and long ones as deflated texts; those of step 3 and 4 are stored apart, once, as numbers.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import MARK_BITS, dropped, filter_bits, mark, marked, marks, stored
from tidemill.llm.components import components
from tidemill.llm.shingles import forest, linked_pairs, mixed, shared_counts, shingle_set

BLOCK, LEADERS = 256, 8
#: Of a sorted set, arrays each of which shares a value with its counterpart of any similar set.
Screen = Callable[[np.ndarray], list[np.ndarray]]


#: Sets of so many bytes, and twice as long as their text is when deflated, are kept as that: they are shuffled more than once.
PACKED = 2048


def packed(values: np.ndarray, text: bytes, k: int) -> bytes:
    """A set as its sorted values, 8 bytes each, or as k and its text, deflated, which is never a multiple of 8 bytes."""
    raw = values.tobytes()
    if len(raw) < PACKED or k > 255:
        return raw
    own = bytes([k]) + zlib.compress(text, 1)
    own += b"\0" * (len(own) % 8 == 0)
    return own if 2 * len(own) <= len(raw) else raw


def unpacked(raw: bytes) -> np.ndarray:
    if len(raw) % 8 == 0:
        return np.frombuffer(raw, np.uint64)
    return shingle_set(zlib.decompressobj().decompress(raw[1:]), raw[0])


def expanded(sets: DataFrame) -> DataFrame:
    """item, n, values as numbers, for sets that are read many times."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([unpacked(v.as_py()).tobytes() for v in batch.column(2)], pa.binary())], names=["item", "n", "values"])

    return sets.select("item", "n", "values").mapInArrow(tasks, "item long, n int, values binary")


def item_sets(items: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """item, n, values (the sorted shingles, packed). items: item, doc_id, h, start, length: where an instance lies,
    a document and its text's hash, and bytes of it (length -1: all). docs: doc_id, text."""
    wanted = items.select("item", F.col("doc_id").alias("w_id"), F.col("h").alias("w_h"), "start", "length")
    texts = marked(docs.select("doc_id", "text"), marks(items, "pairs-marks")).where("marked").withColumn("h", F.xxhash64("text"))
    # by the text's hash alone, so that rows are grouped where they have met; a text may be in docs twice
    near = texts.join(wanted.hint("merge"), (F.col("h") == F.col("w_h")) & F.coalesce(F.col("doc_id") == F.col("w_id"), F.col("doc_id").isNull() & F.col("w_id").isNull()))
    raw = F.col("text").cast("binary")
    text = F.when(F.col("length") < 0, raw).otherwise(F.substring(raw, F.col("start") + 1, F.col("length")))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [raw.as_py() for raw in batch.column(1)]
            sets = [shingle_set(text, k) for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([packed(s, text, k) for s, text in zip(sets, texts)], pa.binary())], names=["item", "n", "values"])

    once = near.select("h", "item", text.alias("text")).groupBy("h", "item").agg(F.first("text").alias("text"))
    return once.select("item", "text").mapInArrow(tasks, "item long, n int, values binary")


def of_items(sets: DataFrame, keys: DataFrame, name: str = "item") -> DataFrame:
    """The sets that a join on keys' column of items needs, and few others: only these are shuffled then."""
    bits = marks(keys.select(F.col(name).alias("doc_id")), "pairs-set-marks")
    return marked(sets.withColumn("doc_id", F.col("item")), bits).where("marked").drop("doc_id", "marked")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def verified(pairs: DataFrame, sets: DataFrame, percent: int, screen: Screen | None = None) -> DataFrame:
    """Those of pairs (a, b, hot) whose sets are similar. A screen tells hot ones apart that need no comparison."""
    pairs = stored(pairs.select("a", "b", "hot"), "pairs-compared")
    side = lambda x: of_items(sets, pairs, x).select(F.col("item").alias(x), F.col("values").alias(f"of_{x}"))
    both = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left, parts = None, None, None
        for batch in batches:
            kept = []
            ids, hots = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, (a, hot) in enumerate(zip(ids, hots)):
                if a != last:
                    last, left, parts = a, unpacked(batch.column(3)[i].as_py()), None
                right = unpacked(batch.column(4)[i].as_py())
                if screen and hot:
                    parts = parts or screen(left)
                    if not all(np.isin(x, y).any() for x, y in zip(parts, screen(right))):
                        continue
                if similar(left, right, percent):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return both.select("a", "b", "hot", "of_a", "of_b").mapInArrow(tasks, "a long, b long")


def size_class(n, percent: int):
    """Sets that can be similar lie in the same class or the next (classes are a little wider than the least ratio)."""
    return F.floor(F.log(n.cast("double")) / F.lit(-math.log((percent - 1) / 100))).cast("int")


def block_tasks(members: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """task, side, item, piece. members: group, item, n, piece. In a task meet a block of sets outside of a group's largest
    piece (side 0) and a block of all its sets (side 1) of sizes that can be similar."""
    cells = members.withColumn("cell", size_class(F.col("n"), percent))
    sizes = members.groupBy("group", "piece").agg(F.count(F.lit(1)).alias("rows"))
    largest = stored(sizes.groupBy("group").agg(F.max_by("piece", F.struct("rows", "piece")).alias("largest")), "pairs-largest")
    cells = cells.join(largest, "group")
    sides = {0: stored(cells.where("piece <> largest"), "pairs-left"), 1: cells}
    parts = {s: stored(rows.groupBy("group", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")), "pairs-parts") for s, rows in sides.items()}
    out = []
    for s, rows in sides.items():
        own = rows.join(parts[s], ["group", "cell"]).withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int")).drop("parts")
        own = own.withColumn("near", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
        met = own.join(parts[1 - s].withColumnRenamed("cell", "near"), ["group", "near"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        ends = [F.struct(c.alias("cell"), p.alias("part")) for c, p in ((F.col("cell"), F.col("part")), (F.col("near"), F.col("other")))]
        out.append(met.select(F.xxhash64("group", *(ends if s == 0 else ends[::-1])).alias("task"), F.lit(s).alias("side"), "item", "piece"))
    return out[0].unionByName(out[1])


def blockwise(members: DataFrame, sets: DataFrame, percent: int, screen: Screen | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between pieces of groups. members: group, item, n, piece."""
    tasks = stored(block_tasks(members, percent, block), "pairs-tasks").join(sets.select("item", "values").hint("merge"), "item")

    def compare(t: pa.Table) -> pa.Table:
        sides: list[dict[int, tuple]] = [{}, {}]
        for side, item, piece, values in zip(*(t.column(c).to_pylist() for c in ("side", "item", "piece", "values"))):
            sides[side][item] = piece, np.frombuffer(values, np.uint64)
        (left, a), (right, b) = (([x[1] for x in s.values()], list(s)) for s in sides)
        kept = []
        if left and right:
            may = True
            if screen:
                for x, y in zip(zip(*map(screen, left)), zip(*map(screen, right))):
                    may = may & (shared_counts(list(x), list(y)) > 0)
            found = [(a[i], b[j]) for i, j in linked_pairs(left, right, percent, may=may) if sides[0][a[i]][0] != sides[1][b[j]][0]]
            kept = forest(found)
        return pa.table({"a": pa.array([x for x, _ in kept], pa.int64()), "b": pa.array([y for _, y in kept], pa.int64())})

    return tasks.groupBy("task").applyInArrow(compare, "a long, b long")


def shingle_counts(members: DataFrame, sets: DataFrame) -> DataFrame:
    """group, shingle, c: how many of a group's members (group, item) have each shingle, added up in each batch first."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(v.as_py(), np.int64) for v in batch.column(1)]
            shingle = np.concatenate(own) if own else np.zeros(0, np.int64)
            group = np.repeat(batch.column(0).to_numpy(), [len(v) for v in own])
            order = np.lexsort((shingle, group))
            group, shingle = group[order], shingle[order]
            first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (shingle[1:] != shingle[:-1]))[: len(group)])
            yield pa.RecordBatch.from_arrays([pa.array(group[first]), pa.array(shingle[first]), pa.array(np.diff(np.append(first, len(group))))], names=["group", "shingle", "c"])

    held = members.join(sets.select("item", "values").hint("merge"), "item").select("group", "values")
    return held.mapInArrow(tasks, "group long, shingle long, c long").groupBy("group", "shingle").agg(F.sum("c").alias("c"))


def common_shingles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """group, common: the shingles that half of a group's members or more have; twice as many as a member has, at most."""
    size = stored(members.groupBy("group").agg(F.count(F.lit(1)).alias("size")), "pairs-sizes")
    half = shingle_counts(members, sets).join(size, "group").where("2 * c >= size")
    return stored(half.groupBy("group").agg(F.sort_array(F.collect_list("shingle")).alias("common")), "pairs-common")


def _held(members: DataFrame, sets: DataFrame, common: DataFrame, more: str) -> DataFrame:
    rows = members.join(sets.select("item", "values").hint("merge"), "item").join(common.hint("merge"), "group", "left")
    return rows.select("group", "item", more, "values", "common")


def _common_to(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """A row's shingles, and which of them are common in its group."""
    own = np.frombuffer(batch.column(3)[i].as_py(), np.uint64)
    common = batch.column(4)[i]
    return own, np.isin(own, common.values.to_numpy().view(np.uint64)) if common.is_valid else np.zeros(len(own), bool)


def leaders(members: DataFrame, sets: DataFrame, common: DataFrame) -> DataFrame:
    """group, l (item, piece): of each of LEADERS parts of a group's members (group, item, piece) the one that is most of the
    others' kind: most common shingles, least others. What is similar to any member is so to such ones, mostly."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [2 * int(shared.sum()) - len(own) for own, shared in (_common_to(batch, i) for i in range(batch.num_rows))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score, pa.int64())], names=["group", "item", "piece", "score"])

    scored = _held(members, sets, common, "piece").mapInArrow(tasks, "group long, item long, piece long, score long")
    draw = F.pmod(F.xxhash64("item"), F.lit(LEADERS))
    return scored.groupBy("group", draw.alias("draw")).agg(F.max_by(F.struct("item", "piece"), F.struct("score", "item")).alias("l")).drop("draw")


def size_step(n: np.ndarray | int) -> np.ndarray:
    """Steps of sizes, 5 percent each; small sizes have one of their own."""
    return np.floor(np.log(n) / math.log(1.05) + 1e-9).astype(np.int64)


def sized_tokens(group: int, shingles: np.ndarray, step: np.ndarray | int) -> np.ndarray:
    own = mixed(np.array([group], np.int64).view(np.uint64), 51) ^ mixed(np.atleast_1d(step).astype(np.uint64), 53)
    return mixed(shingles ^ own, 52).view(np.int64)


def group_prefixes(members: DataFrame, sets: DataFrame, common: DataFrame, percent: int) -> DataFrame:
    """token, item, n: of each member outside of its group's largest piece, its prefix (what is not common in its group first),
    for each size that a similar set may have; and of all members those of their shingles that are among these for their size."""
    sizes = members.groupBy("group", "piece").agg(F.count(F.lit(1)).alias("rows"))
    largest = stored(sizes.groupBy("group").agg(F.max_by("piece", F.struct("rows", "piece")).alias("largest")), "pairs-largest")
    outside = members.join(largest, "group").where("piece <> largest").select("group", "item", "n")
    made = lambda token, item, n: pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.full(len(token), item, np.int64)), pa.array(np.full(len(token), n, np.int32))], names=["token", "item", "n"])

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (group, item) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                own, shared = _common_to(batch, i)
                n = len(own)
                least = -(-percent * n // 100)
                own = own[np.lexsort((mixed(own, 54), shared))[: n - least + 1]]
                # a set that has the i-th and none before it shares n - i values at most (i from 0), which is enough for
                # similarity only if it is at most so large
                most = np.minimum((n - np.arange(len(own))) * (100 + percent) // percent - n, 100 * n // percent)
                own, most = own[most >= least], most[most >= least]
                first, last = int(size_step(least)), size_step(most)
                count = last - first + 1
                at = np.repeat(np.arange(len(own)), count)
                step = first + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                yield made(sized_tokens(group, own[at], step), item, n)

    own = stored(_held(outside, sets, common, "n").mapInArrow(prefix, "token long, item long, n int"), "pairs-outside")
    bits = members.sparkSession.sparkContext.broadcast(filter_bits(own, "token"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, item, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                shingles = np.frombuffer(values.as_py(), np.uint64)
                token = sized_tokens(group, shingles, size_step(max(1, len(shingles))))
                at = token & (MARK_BITS - 1)
                yield made(token[(bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)], item, len(shingles))

    met = members.join(sets.select("item", "values").hint("merge"), "item").select("group", "item", "values").mapInArrow(probe, "token long, item long, n int")
    return own.unionByName(met)


def left_over(members: DataFrame, sets: DataFrame, common: DataFrame, percent: int, screen: Screen | None, block: int) -> DataFrame:
    """Links (a, b) between pieces of groups (members: group, item, n, piece), by prefixes, then by blocks."""
    from tidemill.llm.ngram_join import candidates

    found = stored(candidates(group_prefixes(members, sets, common, percent), percent, orders=1), "pairs-prefixes")
    end = lambda x: members.select(F.col("item").alias(x), F.col("piece").alias(f"of_{x}")).hint("merge")
    cross = found.where("NOT hot").join(end("a"), "a").join(end("b"), "b").where("of_a <> of_b").select("a", "b", "hot")
    links = verified(cross, sets, percent)
    hot = found.where("hot").select("a", "b")
    if hot.limit(1).count() == 0:
        return links
    groups = stored(components(hot), "pairs-blocked").select(F.col("node").alias("item"), F.col("component").alias("group"))
    return links.unionByName(blockwise(members.drop("group").join(groups, "item"), sets, percent, screen, block))


def grown(known: DataFrame, links: DataFrame) -> DataFrame:
    """node, component: known components, joined by more links."""
    return stored(components(known.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)), "pairs-components")


def pieces(groups: DataFrame, known: DataFrame) -> DataFrame:
    """group, item, n, piece (its known component) of groups' members (group, item, n), of groups in several pieces."""
    rows = groups.join(known.hint("merge"), groups["item"] == known["node"], "left").select("group", "item", "n", F.coalesce("component", "item").alias("piece"))
    several = rows.groupBy("group").agg((F.min("piece") != F.max("piece")).alias("several")).where("several").select("group")
    return stored(rows.join(stored(several, "pairs-several"), "group"), "pairs-pieces")


def similar_components(candidates: DataFrame, sets: DataFrame, percent: int, screen: Screen | None = None, block: int = BLOCK) -> DataFrame:
    """node, component (its least node) of all items that a chain of similar candidates (a, b, hot: long, long, boolean,
    a < b) connects with others. sets: item, n, values."""
    least = stored(candidates.groupBy("b").agg(F.min("a").alias("least")), "pairs-least")
    of_least = F.col("a") == F.col("least")
    rows = candidates.join(least.hint("merge"), "b")
    begin = mark()
    known = stored(components(verified(rows.where(of_least), sets, percent, screen)), "pairs-components")
    dropped(sets.sparkSession, begin)
    end = lambda x: known.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")).hint("merge")
    rest = rows.where(~of_least).join(end("a"), "a", "left").join(end("b"), "b", "left")
    rest = rest.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b", "hot")
    if candidates.where("hot").limit(1).count() == 0:
        return grown(known, verified(rest, sets, percent, screen))
    begin = mark()
    whole = stored(components(candidates.select("a", "b")), "pairs-groups")
    dropped(sets.sparkSession, begin)
    hot = stored(candidates.where("hot").join(whole, F.col("a") == F.col("node")).select(F.col("component").alias("group")).distinct(), "pairs-hot")
    groups = whole.withColumnRenamed("component", "group").join(hot, "group").join(sets.select(F.col("item").alias("node"), "n").hint("merge"), "node")
    members = pieces(groups.select("group", F.col("node").alias("item"), "n"), known)
    own = stored(expanded(of_items(sets, members)), "pairs-member-sets")
    common = common_shingles(members, own)
    leader = stored(leaders(members, own, common), "pairs-leaders")
    meet = members.join(leader, "group").where("piece <> l.piece").select(F.least("item", "l.item").alias("a"), F.greatest("item", "l.item").alias("b"), F.lit(True).alias("hot"))
    known = grown(known, verified(rest.unionByName(meet), sets, percent, screen))
    members = pieces(members.drop("piece"), known)
    if members.limit(1).count() == 0:
        return known
    return grown(known, left_over(members, of_items(own, members), common, percent, screen, block))
