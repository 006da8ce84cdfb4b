import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from tidemill.llm import suffix_dedup as D


def brute(rows, length):
    """Digest columns of each row; rows with distinct (id, text)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2]))
    seen, out = set(), []
    for i in order:
        raw = (rows[i][1] or "").encode()
        cover = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                cover[p : p + length] = True
            seen.add(s)
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        spans = int((cover[:-1] & ~np.append(False, cover[:-1])[: len(raw)]).sum())
        out.append((rows[i][0], len(raw), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.choice([25, 60, 120]))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(3)]
        if i % 2:
            parts.insert(1, rng.choice(passages))
        if i % 5 == 0:
            parts.append(rng.choice(passages)[rng.randint(0, 30) :])
        if i % 11 == 0:
            parts.append("=" * rng.choice([99, 100, 101, 350]))
        if i % 13 == 0:
            parts.append("ab" * 120 + "c" + "ab" * 90)
        out.append("\n".join(parts))
    return out + [out[3], out[3] + "x", "y" + out[5], "", "é" * 49, "é" * 50, "é" * 51]


def test_long_common_prefixes():
    rng = np.random.default_rng(2)
    for n, sigma, length in ((1, 1, 1), (2, 1, 3), (300, 2, 5), (500, 3, 12), (400, 1, 100), (700, 200, 2)):
        symbols = np.append(rng.integers(1, sigma + 1, n - 1), 0) if n > 1 else np.zeros(1, np.int64)
        symbols[n // 2] = 0 if n > 10 else symbols[n // 2]
        symbols = np.append(symbols[:-1], 0).astype(np.int64)
        order, far = D.long_common_prefixes(symbols, length)
        heads = [tuple(np.append(symbols, np.full(length, -1))[i : i + length]) for i in order]
        assert sorted(order.tolist()) == list(range(n)) and heads == sorted(heads)
        for i in range(1, n):
            if 0 not in heads[i] and 0 not in heads[i - 1] and -1 not in heads[i] + heads[i - 1]:
                assert far[i] == (heads[i] == heads[i - 1]), (n, i)
            elif heads[i] != heads[i - 1]:
                assert not far[i]


def test_fragments_hold_every_start_once():
    ts = [t.encode() for t in texts(4)]
    owner, start, counts, key, _, loop = D.fragments(ts)
    got = sorted((o, s + i) for o, s, n in zip(owner.tolist(), start.tolist(), counts.tolist()) for i in range(n))
    assert got == [(o, p) for o, t in enumerate(ts) for p in range(len(t) - D.LENGTH + 1)]
    by = {}
    for o, s, n, k in zip(owner.tolist(), start.tolist(), counts.tolist(), key.tolist()):
        for i in range(n):
            assert by.setdefault(ts[o][s + i : s + i + D.LENGTH], k) == k
    for o, s, n, again in zip(owner.tolist(), start.tolist(), counts.tolist(), loop.tolist()):
        assert again or len({ts[o][s + i : s + i + D.LENGTH] for i in range(n)}) == n
    assert 0 < loop.sum() < len(loop)


@pytest.mark.parametrize("seed,hot,chunk", [(1, 4000, 1 << 20), (2, 2, 2000), (3, 4000, 500)])
def test_against_brute_force(spark, monkeypatch, seed, hot, chunk):
    monkeypatch.setattr(D, "HOT", hot)
    monkeypatch.setattr(D, "BUCKET_BYTES", 5000)
    ts = texts(seed)
    random.Random(seed).shuffle(ts)
    rows = [(i * 7 % 101, t, 0) for i, t in enumerate(ts)]
    df = spark.createDataFrame([(d, t, "x") for d, t, _ in rows], "doc_id long, text string, spans string")
    D.CHUNK_BYTES = chunk
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.text).hexdigest()) for r in D.deduplicated(df).collect()), key=repr)
    D.CHUNK_BYTES = 1 << 20
    assert got == brute(rows, D.LENGTH)
    assert sum(r[2] > 0 for r in got) > 15


def test_unclear_ids(spark):
    a, b = "one text of some length " * 3 + "q" * 60, "another " * 4 + "z" * 120
    rows = [(1, a), (1, a), (1, b), (None, a), (None, None), (2, b)]
    got = D.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in got), key=repr)
    inner = brute([(1, b, 0)], 100)[0][2]
    assert by == sorted([(1, len(a), 0), (1, len(a), 0), (1, len(b), inner), (None, len(a), len(a)), (None, 0, 0), (2, len(b), len(b))], key=repr)
    assert D.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_real_documents(spark):
    rows = [(r.doc_id, r.text, 0) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted((tuple(r) for r in D.op4_suffix_dedup(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == brute(rows, D.LENGTH)


def test_long_runs_of_one_key_go_in_slices(spark, monkeypatch):
    met = []
    monkeypatch.setattr(D, "HOT_BYTES", 3000, raising=False)
    monkeypatch.setattr(D, "SLICE_BYTES", 700, raising=False)
    monkeypatch.setattr(D, "SLICE_STARTS", 300, raising=False)
    own = D.compared
    monkeypatch.setattr(D, "compared", lambda parts, length: met.append(parts) or own(parts, length))
    texts_ = ["ab " * 3000, "x" * 1500 + " tail " + "ab " * 1200 + "end", "one word " * 800, "y" + "x" * 1000, "nothing that repeats " + "z" * 120]
    rows = [(i, t, 0) for i, t in enumerate(texts_)]
    df = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.text).hexdigest()) for r in D.deduplicated(df).collect()), key=repr)
    assert got == brute(rows, D.LENGTH)
    assert max([len(r.content) for r in met[0].collect()], default=0) <= 3000


def test_memory_of_a_task():
    """A worker's arrays are bounded by few bytes for each byte of its fragments."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij ", k=6)) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=80)).encode() for _ in range(500)]
    texts += [t[100:400] for t in texts[::3]]
    tracemalloc.start()
    try:
        out = D.covered_starts(texts, np.arange(len(texts)) << 40)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(map(len, out)) == 167 * 201
    assert peak < 75 * sum(map(len, texts))
