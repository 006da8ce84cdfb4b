"""Connected components of links, by alternating large and small stars.

Tasks first replace their own links by stars. Each round then replaces links by links to least neighbours, until only stars
are left. Neighbours are added up before they are shuffled, and the least ones are stored before links meet them, so that
adaptive execution can split a hub's links. What a round has stored goes when the next links stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import dropped, mark, stored

MOST_ROUNDS, MOST_LINKS = 40, 1 << 18


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of links a - b that is not the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        for end in (root[x], root[y]):
            np.minimum.at(root, end, low)
        while (root[root] != root).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def thinned(links: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """Links (a, b) that connect the same: the stars of each MOST_LINKS links of a task."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda held: pa.RecordBatch.from_arrays([pa.array(c) for c in stars(*map(np.concatenate, zip(*held)))], names=["a", "b"])
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= most:
                yield made(held)
                held, n = [], 0
        if held:
            yield made(held)

    return links.mapInArrow(tasks, "a long, b long")


def are_stars(links: DataFrame) -> bool:
    """Whether of links (a > b, none twice) each a has one, and is no b."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    bad = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1")
    return bad.limit(1).count() == 0


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """links point downward (a > b)."""
    least = stored(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of all nodes of links (a, b: long)."""
    begin = mark()
    down = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    down = stored(thinned(down).distinct(), "links")
    for _ in range(MOST_ROUNDS):
        if are_stars(down):
            break
        down = stored(_small(stored(_large(down), "links-large")), "links")
        dropped(down.sparkSession, begin)
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    # each node but the least of its component has one link now
    return down.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(down.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
