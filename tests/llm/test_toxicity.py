import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import toxicity as T


def test_windows_cover_and_overlap():
    for n in (0, 1, 39, 40, 41, 70, 71, 1000):
        at, owner = T.windows_of([3, n, 2])
        own = at[owner == 1] - 3
        assert set(own[own >= 0].ravel()) == set(range(n)) and (owner == 1).sum() == len(T.spans(n)) >= 1
        assert [(r[0], r[r >= 0][-1] + 1) if n else (0, 0) for r in own] == T.spans(n)


def test_gradients_are_right():
    rng = np.random.default_rng(3)
    net = T.Network(5)
    words = [bytes(rng.integers(97, 105, 4)) for _ in range(30)]
    words = list(dict.fromkeys(words))
    index, owner = T.windows_of([len(words), 5])
    index = np.where(index >= len(words), index - len(words), index)
    ids, trigrams, offsets = T.features(words)
    up = rng.standard_normal(len(index)).astype(np.float32)

    def loss():
        x = net.vectors(ids, trigrams, offsets)
        return float((net.run(net.gates(x), index).astype(np.float64) * up).sum())

    x = net.vectors(ids, trigrams, offsets)
    gates = net.gates(x)
    _, trace = net.run(gates, index, trace=True)
    grads, d_x = net.gradients(gates, index, x, trace, up)
    grads["word"] = np.zeros_like(net.p["word"])
    np.add.at(grads["word"], ids % T.WORDS, d_x[:, : T.WORD_SIZE])
    for name in ("in", "own", "bias", "look", "key", "out", "base", "word"):
        flat, g = net.p[name].reshape(-1), grads[name].reshape(-1)
        for i in np.argsort(-np.abs(g))[:4]:
            old, step = flat[i], 1e-2
            flat[i] = old + step
            a = loss()
            flat[i] = old - step
            b = loss()
            flat[i] = old
            assert abs((a - b) / (2 * step) - g[i]) < 2e-2 * max(1, abs(g[i])), name


def test_learns_planted_words_and_batches_alike(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 150))]
        if i % 4 == 0:
            w.insert(rng.randint(0, len(w)), rng.choice(["zorkish", "zorkly", "mux"]))
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    net = T.trained(texts[:300], labels[:300], updates=150)
    scores = T.Scorer(net)(texts[300:])
    assert ((scores >= 0.5) == np.array(labels[300:])).mean() > 0.95
    long = "fine words " * 70_000 + " mux zorkish " + "fine words " * 10
    odd = texts[300:340] + ["", None, "x" * 5000, long]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(odd)] + [(None, "", "mine")], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in T.scored(df, net).collect()}
    one = T.Scorer(net)
    assert len(got) == len(odd) + 1 and all(abs(one([t])[0] - got[i]) < 1e-5 for i, t in enumerate(odd))
    assert got[len(odd) - 1] > got[len(odd) - 2] or scores.max() < 0.5
    assert T.scored(df.limit(0), net).count() == 0


def test_sample_leaves_out_held_out_rows(spark):
    docs = spark.range(100).selectExpr("id doc_id", "concat('text ', id) text")
    labels = spark.range(100).selectExpr("id doc_id", "cast(id % 3 = 0 as int) toxic").unionByName(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int"))
    rows = T.sample(docs, labels, 20)
    assert len(rows) == 40 and sum(y for _, y in rows) == 20
    assert all(zlib.crc32(t.split()[1].encode()) % 5 for t, _ in rows) and rows == T.sample(docs.repartition(7), labels, 20)
    assert T.sample(docs.limit(0), labels) == []
    assert T.Scorer(T.fitted(docs.limit(0), labels))(["a"])[0] < 0.5
    held = {r.doc_id for r in docs.where(T.held_out("doc_id")).collect()}
    assert held == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0}


def plain_score(net, text):
    """One text, window by window and word by word: two recurrent passes, attention, the largest logit."""
    h, p = T.HIDDEN, net.p
    words = T.words_of(text)
    sig = lambda v: 1 / (1 + np.exp(-v))
    best = -np.inf
    for a, b in T.spans(len(words)):
        if a == b:
            best = max(best, float(p["base"][0]))
            continue
        x = [net.vectors(*T.features([w]))[0].astype(np.float64) for w in words[a:b]]
        states = np.zeros((b - a, 2 * h))
        for d in (0, 1):
            state = np.zeros(h)
            for t in range(b - a) if d == 0 else range(b - a - 1, -1, -1):
                g = x[t] @ p["in"][d] + p["bias"][d]
                z, r = sig(g[:h] + state @ p["own"][d][:, :h]), sig(g[h : 2 * h] + state @ p["own"][d][:, h : 2 * h])
                c = np.tanh(g[2 * h :] + (r * state) @ p["own"][d][:, 2 * h :])
                state = (1 - z) * state + z * c
                states[t, d * h : (d + 1) * h] = state
        e = np.exp(np.tanh(states @ p["look"]) @ p["key"])
        best = max(best, float((e / e.sum()) @ states @ p["out"] + p["base"][0]))
    return sig(best)


def test_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(3)
    lexicon = [f"w{i}é" for i in range(60)]
    for few in (False, True):
        net = T.Network(2)
        for k in ("word", "char", "out", "key"):
            net.p[k] = net.p[k] * 3
        if few:
            net.p["odds"], net.p["char_odds"] = rng.normal(size=T.ODDS).astype(np.float32), rng.normal(size=T.TRIGRAMS).astype(np.float32)
        texts = [" ".join(rng.choice(lexicon, n)) for n in (1, 2, 39, 40, 41, 69, 70, 71, 130, 5)] + ["", None, "x" * 200]
        got = T.Scorer(net)(texts)
        assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-4)
        assert got.std() > 0.01


def test_few_labels():
    """With some forty toxic texts, half of those not trained on are found, and few others."""
    import duckdb

    sf = "/root/testdata/sf0.01"
    rows = duckdb.execute(f"SELECT coalesce(text, ''), toxic FROM '{sf}/documents.parquet' JOIN '{sf}/labels.parquet' USING (doc_id) WHERE toxic IS NOT NULL ORDER BY md5(CAST(doc_id AS VARCHAR))").fetchall()
    found = np.zeros((2, 2), int)
    for k in (0, 1):
        fit = [r for i, r in enumerate(rows) if i % 2 != k and len(r[0]) <= T.SAMPLE_CHARS]
        rest = [r for i, r in enumerate(rows) if i % 2 == k]
        p = T.Scorer(T.trained([t for t, _ in fit], [y for _, y in fit]))([t for t, _ in rest])
        for score, (_, y) in zip(p, rest):
            found[int(y), int(score >= 0.5)] += 1
    print(found)
    assert found[1, 1] >= 0.45 * found[1].sum() and found[0, 1] <= 0.05 * found[0].sum()
