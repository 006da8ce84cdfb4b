import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import quality

TEXTS = ["", None, "a", "a b c", "a b c a b c", "a b a b a b a", "x " * 200, "l one\nl one\n \n\nl one\nother", "# a*b\t$%\x0b&|<>\r\n> é\x1cz\xa0y", "the cat sat the cat sat on the cat sat"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_counts(spark):
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choice("abcd\nef") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    for r in quality.counts(df, ["doc_id"]).collect():
        assert tuple(r)[1:] == brute(texts[r.doc_id]), texts[r.doc_id]
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in quality.counts(real, ["doc_id", "text"]).collect():
        assert tuple(r)[2:] == brute(r.text)


def statistics(n, seed, lang, source, first):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [500 + int(rng.gauss(0, 40)), 520 + int(rng.gauss(0, 20)), int(abs(rng.gauss(0, 8))), 0, int(abs(rng.gauss(0, 10)))]
        if i % 10 == 9:  # a tenth lies far off, all at one place
            w = [500, 520, 480, 0, 0]
        out.append((first + i, lang, source, *w))
    return out


SCHEMA = "doc_id long, lang string, source string, " + ", ".join(f"{s} long" for s in quality.STATS)


def weights(cell):
    """1 for the SHARE nearest rows; of the cell in which the last ones lie, what makes the share exact."""
    order = np.sort(cell)
    half = int(np.ceil(quality.SHARE * len(cell)))
    last = order[half - 1]
    return np.where(cell < last, 1.0, np.where(cell == last, (half - (cell < last).sum()) / (cell == last).sum(), 0.0))


def moments(x, w):
    m = (w[:, None] * x).sum(0) / w.sum()
    return m, ((x - m) * w[:, None]).T @ (x - m) / w.sum() + np.eye(5) * quality.FLOOR**2


def plain_estimate(x, trace=None):
    """Concentration steps in numpy, from both starts, until no step lowers the determinant; and the scale."""

    def cells(m, c):
        d = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)
        return np.floor(quality.GRID * np.log2(np.maximum(d, 1e-4)) + 1e-9)

    half = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
    med = half(x)
    sd = np.maximum(1.4826 * half(abs(x - med)), quality.FLOOR)
    u = (x - med) / sd
    u = u / np.maximum(np.linalg.norm(u, axis=1), 1e-9)[:, None]
    best = None
    for c in (np.diag(sd**2), 5 * u.T @ u / len(x) * np.outer(sd, sd) + np.eye(5) * quality.FLOOR**2):
        m, c = moments(x, weights(cells(med, c)))
        while True:
            new = moments(x, weights(cells(m, c)))
            if np.linalg.slogdet(new[1])[1] >= np.linalg.slogdet(c)[1] - quality.STANDS:
                break
            m, c = new
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0] - 1e-9:
            best = det, m, c
    _, m, c = best
    return m, c, min(1.0, quality.CHI2_HALF / 2 ** ((half(cells(m, c)) + 1) / quality.GRID))


def plain_distances(rows):
    x = np.array([r[3:] for r in rows]) / quality.SCALE
    own, lang = [(r[1], r[2]) for r in rows], [r[1] for r in rows]
    of = lambda keys: {k: (sum(y == k for y in keys), plain_estimate(x[[i for i, y in enumerate(keys) if y == k]])) for k in set(keys)}
    e0, e1, (n2, e2) = of(own), of(lang), of([0] * len(rows))[0]
    out = {}
    for r, p in zip(rows, x):
        (n0, a), (n1, b) = e0[r[1], r[2]], e1[r[1]]
        w0, w1 = n0 / (n0 + quality.PRIOR), n1 / (n1 + quality.PRIOR)
        m, c, logs = (w0 * f(a) + (1 - w0) * (w1 * f(b) + (1 - w1) * f(e2)) for f in (lambda e: e[0], lambda e: e[1], lambda e: np.log(e[2])))
        out[r[0]] = (p - m) @ np.linalg.inv(c) @ (p - m) * np.exp(logs)
    return out


def test_distances_and_outliers(spark):
    """Against numpy; a tenth of each group lies far off and is found, in groups of any size."""
    rows = statistics(600, 1, "en", "a", 0) + statistics(60, 5, "en", "few", 700) + statistics(400, 2, None, None, 1000) + statistics(150, 3, "fr", "x", 2000) + statistics(150, 4, "fr", "y", 3000) + statistics(2, 6, "xx", "z", 4000)
    df = spark.createDataFrame(rows, SCHEMA)
    levels, groups, few = quality.grouped(df)
    assert groups.count() == 6 and levels.count() == 3 * len(rows) and few
    estimates = quality.blended(groups, quality.estimated(levels, few))
    far = quality._distance(quality.joined(df.withColumn("g0", quality.group(0)), estimates, "g0", few)).collect()
    want = plain_distances(rows)
    assert len(far) == len(rows)
    for r in far:
        assert abs(r.d2 * r.scale - want[r.doc_id]) < 0.05 * max(1, want[r.doc_id]), r.doc_id
        assert (r.d2 * r.scale > quality.CUTOFF) == (r.doc_id % 10 == 9)


def test_step_is_the_estimate_of_the_nearest_rows(spark):
    rows = statistics(500, 7, "en", "a", 0)
    df = spark.createDataFrame(rows, SCHEMA)
    good = df.withColumn("g", quality.group(0)).cache()
    start = quality.first_estimates(good, True)
    step = {r.start: r for r in quality.concentrated(good, start, True).collect()}
    x = np.array([r[3:] for r in rows]) / quality.SCALE
    for e in start.collect():
        low = np.array([[e[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        z = np.linalg.solve(low, (x - np.array([e[f"m_{i}"] for i in range(5)])).T)
        cell = np.floor(quality.GRID * np.log2(np.maximum((z * z).sum(0), 1e-4)))
        w = weights(cell)
        assert np.isclose(w.sum(), np.ceil(quality.SHARE * len(x)))
        m, c = moments(x, w)
        got = step[e.start]
        assert np.allclose(m, [got[f"m_{i}"] for i in range(5)])
        assert np.isclose(np.linalg.slogdet(c)[1], got.logdet)


def test_no_determinant_rises_and_steps_end(spark, monkeypatch):
    """On groups whose rows lie in many lumps, where whole cells would swing: each start's determinants fall to the last."""
    rng = random.Random(11)
    rows = []
    for g in range(12):
        for i in range(rng.choice([3, 40, 300])):
            lump = rng.choice([(500, 520, 0, 0, 0), (420, 500, 90, 0, 30), (610, 540, 0, 200, 120)])
            rows.append((len(rows), "en", f"s{g}", *(v + int(rng.gauss(0, 6)) * (v > 0) for v in lump)))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("g", quality.group(0)).cache()
    seen = []
    step = quality.concentrated
    monkeypatch.setattr(quality, "concentrated", lambda *a: (seen.append(a[1]), step(*a))[1])
    end = {(r.g, r.start): r.logdet for r in quality.settled(df, quality.first_estimates(df, True), True).collect()}
    assert len(end) == 24
    was = {}
    for estimates in seen[1:]:
        for r in estimates.collect():
            assert r.logdet < was.get((r.g, r.start), 1e9) - quality.STANDS
            was[r.g, r.start] = r.logdet
    assert was == end


def test_tables(spark):
    df = spark.createDataFrame([(i, t, None, None, "g") for i, t in enumerate(TEXTS * 2)] + [(None, "a " * 60, "en", "s", "g")], "doc_id long, text string, lang string, source string, g string")
    out = quality.judged(df, ["doc_id"]).collect()
    assert len(out) == 21 and not any(r.kept and r.base_failed for r in out)
    assert quality.judged(df.limit(0), ["doc_id"]).count() == 0
