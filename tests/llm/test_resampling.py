"""Resampling against a plain version that hashes every run of words by itself."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from tidemill.llm import resampling as S

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for i in range(len(w)) for n in (1, 2, 3) if i + n <= len(w)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def plain(docs, target):
    s = Counter(bucket(f) for _, t in docs for f in features(t))
    t = Counter(bucket(f) for x in target for f in features(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))
    out = []
    for doc_id, text in docs:
        f = features(text)
        weight = sum(gain(bucket(x)) for x in f)
        out.append((doc_id, len(words(text)), len(f), weight, weight + S.noise(doc_id, "42")))
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: 5 * len(fit) // 100])}
    return [(*r, rank.get(id(r))) for r in out]


def test_streams():
    texts = ["Ab cd-EF  gh", "", None, "one", "two words", "é ü x" * 30, "z" * 3000 + " end " + "y" * 70_000, "A1_b2\0c3"]
    stream, n_words, n_features = S.Streams()(texts)
    assert n_words.tolist() == [len(words(t)) for t in texts] and n_features.tolist() == [len(features(t)) for t in texts]
    assert stream.tolist() == [bucket(f) for t in texts for f in features(t)]


def test_edges_and_ties(spark):
    rng = np.random.default_rng(3)
    lexicon = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(lexicon, rng.integers(0, 90)))) for i in range(400)]
    docs += [(500 + i, "the very same text of a copy " * 5) for i in range(60)] + [(600, None), (601, ""), (602, docs[5][1] * 400)]
    docs += [(None, "no id here " * 9), (3, docs[3][1])]
    target = [" ".join(rng.choice(lexicon[:40], 30)) for _ in range(20)] + [None]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, rank int, id int").repartition(7)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = sorted((tuple(r) for r in S.resampled(df, bench).collect()), key=repr)
    assert got == sorted(plain(docs, target), key=repr)
    assert sum(r[5] is not None for r in got) > 15


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert S.resampled(none, bench).collect() == []
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert [r.rank for r in S.resampled(some, bench).collect()] == [None]
    assert [r.rank for r in S.resampled(some, bench, percent=100).collect()] == [1]
