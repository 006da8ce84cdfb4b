import itertools
import random
import re

import numpy as np
import pytest

from tidemill.llm import paragraph_dedup as P


def plain_units(text, least):
    """(start, end, words, kinds) of lines, and of sentences of lines with several, by regular expressions."""
    out = []
    for line in re.finditer(r"[^\n]+", text):
        words = line[0].split()
        sentences = [m for m in re.finditer(r"\S.*?(?:[.!?](?=\s)|$)", line[0])]
        out.append((line.start(), line.end(), words, "L" if len(sentences) > 1 else "LS"))
        if len(sentences) > 1:
            for a, b in zip(sentences, [*[s.start() for s in sentences[1:]], len(line[0])]):
                out.append((line.start() + (a.start() if a is not sentences[0] else 0), line.start() + b, a[0].split(), "S"))
    return [u for u in out if len(u[2]) >= least]


def grams(words):
    words = [w.lower() for w in words]
    return {tuple(words[i : i + P.K]) for i in range(max(1, len(words) - P.K + 1))}


def alike(a, b):
    return 100 * len(a & b) >= P.PERCENT * len(a | b)


def brute(rows, least=P.LEAST):
    """Kept texts, by comparing all lines and sentences as sets of word tuples. No run of a window's length may repeat beyond them."""
    found = [(d is None, d or 0, r, a, b, grams(w), kinds) for r, (d, text) in enumerate(rows) for a, b, w, kinds in plain_units(text or "", least)]
    found.sort(key=lambda u: u[:2] + (u[3],))
    parent = list(range(len(found)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(found)), 2):
        if found[i][5] == found[j][5] or set(found[i][6]) & set(found[j][6]) and alike(found[i][5], found[j][5]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    gone = {}
    for i, u in enumerate(found):
        f = found[root(i)]
        if not (u[2] == f[2] and u[3] < f[4] and f[3] < u[4]):
            gone.setdefault(u[2], set()).update(range(u[3], u[4]))
    out = []
    for r, (d, text) in enumerate(rows):
        text, at = text or "", gone.get(r, set())
        for line in re.finditer(r"[^\n]*", text):  # a line that goes takes its newline along
            if line[0] and line.end() < len(text) and all(i in at for i in range(line.start(), line.end())):
                at.add(line.end())
        out.append((d, "".join(c for i, c in enumerate(text) if i not in at)))
    return sorted(out, key=repr)


def numbered(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def changed(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.choice([0, 1, len(words) - 1])] = numbered(rng, 1)[0]
    return words


def kept(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in P.deduplicated(df, **more).orderBy("doc_id").collect()]


def test_tuned():
    for t in (0.5, 0.8, 0.9):
        bands, rows = P.tuned(t)
        assert 1 - (1 - t**rows) ** bands >= P.RECALL and bands * rows <= P.MOST_HASHES
    with pytest.raises(ValueError):
        P.tuned(0.1, 0.999, 4)


@pytest.mark.parametrize("least", [1, P.LEAST])
def test_units(least):
    """Places and identity of units, by plain Python."""
    rng = random.Random(least)
    texts = ["", " \n\n", "One two. Three! four?\n\n  last line. end", "x y z", "é. à b c d e\r\nf"]
    texts += ["\n".join(" ".join(w + rng.choice(["", "", "", ".", "!?"]) for w in numbered(rng, rng.randrange(40))) for _ in range(6)) for _ in range(20)]
    u = P.units([t.encode() for t in texts], least)
    got = sorted((int(t), texts[t].encode()[s : s + n].lower().split(), (i, m)) for t, s, n, i, m, w in zip(u.text, u.start, u.length, u.item, u.more, u.window) if not w)
    want = sorted((t, [w.encode() for w in words]) for t, text in enumerate(texts) for _, _, words, _ in plain_units(text.lower(), least))
    assert [(t, words) for t, words, _ in got] == want
    by_words = {}
    for _, words, item in got:
        assert by_words.setdefault(tuple(words), item) == item
    assert len(set(by_words.values())) == len(by_words)


@pytest.mark.parametrize("seed", [1])
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    shared = [numbered(rng, rng.randrange(6, 25)) for _ in range(12)]
    rows = []
    for i in range(90):
        lines = [numbered(rng, rng.choice([3, 14, 30])) for _ in range(3)]
        for _ in range(i % 3):
            unit = changed(rng, rng.choice(shared), rng.choice([0, 0, 1, 2]))
            at = rng.randrange(len(lines))
            if rng.random() < 0.5:
                lines[at] = [*lines[at][:-1], lines[at][-1] + ".", *unit[:-1], unit[-1] + "!", *numbered(rng, 9)]
            else:
                lines.insert(at, unit)
        rows.append((200 - i, "\n".join(map(" ".join, lines))))
    rows += [(500, ""), (501, None), (502, "\n\n"), (None, " ".join(shared[0]).upper()), (None, " ".join(numbered(rng, 20)))]
    df = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, n_spans int")
    got = P.deduplicated(df).collect()
    want = brute(rows)
    assert sorted(((r.doc_id, r.text or "") for r in got), key=repr) == want
    assert all(r.n_bytes - r.n_removed == len((r.text or "").encode()) and (r.n_spans > 0) == (r.n_removed > 0) == bool(r.kept_with) for r in got if r.doc_id)
    assert sum(r.n_removed > 0 for r in got) > 20


def test_short_units_too(spark):
    """With a bound of one word, units of all lengths are compared."""
    rng = random.Random(3)
    texts = []
    for n in [*range(1, 25)]:
        unit = numbered(rng, n)
        texts += [" ".join(unit), " ".join(numbered(rng, 20)) + ". " + " ".join(unit[:-1] + ["new"]), " ".join(unit)]
    got = kept(spark, texts, least_words=1)
    assert got == [t for _, t in sorted(brute(list(enumerate(texts)), 1))]
    assert sum(g != t for g, t in zip(got, texts)) == 24 + 12  # from 13 words on, one changed word at the end leaves 80 percent


def test_passages_not_at_boundaries(spark):
    """Of a run of WINDOW + STEP - 1 words or more only ends of less than STEP words are left, wherever it lies; the rest stays."""
    rng = random.Random(4)
    shortest = numbered(rng, P.WINDOW + P.STEP - 1)
    long = numbered(rng, 200)
    dotted = [w + "." * (i % 4 == 3) for i, w in enumerate(numbered(rng, 60))]
    lines = [w + "\n" * (i % 7 == 6) for i, w in enumerate(numbered(rng, 70))]
    passages = [shortest, long, dotted, lines]
    hosts = [(numbered(rng, 37), numbered(rng, 41)) for _ in passages]
    texts = [" ".join(numbered(rng, 33) + x + numbered(rng, 45)) for x in passages]
    texts += [" ".join(a + x + b) for x, (a, b) in zip(passages, hosts)]
    near = long[:100] + ["changed"] + long[101:]
    texts += [" ".join(numbered(rng, 37) + near + numbered(rng, 41)), "one " + "and again " * 200 + "end"]
    got = kept(spark, texts)
    assert got[:4] == texts[:4]
    for g, x, (a, b) in zip(got[4:8], passages, hosts):
        left = g.split()
        assert left[:37] == a and left[-41:] == b
        middle, x = left[37:-41], " ".join(x).split()
        ends = [i for i in range(len(middle) + 1) if middle == x[:i] + x[len(x) - len(middle) + i :] and max(i, len(middle) - i) < P.STEP]
        assert ends, middle
    assert "changed" in got[8] and len(got[8].split()) < 37 + 41 + 4 * P.STEP
    assert got[9].startswith("one and again") and len(got[9].split()) < 2 * P.WINDOW + P.STEP


def test_every_run_has_a_shared_window():
    rng = random.Random(5)
    for n in (P.WINDOW + P.STEP - 1, 60, 90):
        run = numbered(rng, n)
        found = []
        for _ in range(2):
            u = P.units([b"other text", " ".join(numbered(rng, 31) + run + numbered(rng, 29)).encode()])
            found.append(set(zip(u.item[u.window].tolist(), u.more[u.window].tolist())))
        assert found[0] & found[1]


def test_recall_of_bands():
    """Of pairs of 80 percent and a little more, the bands find nearly all."""
    rng = np.random.default_rng(6)
    hit = total = 0
    for _ in range(300):
        n = int(rng.integers(25, 120))
        words = [f"w{x}" for x in rng.integers(0, 10**9, n)]
        other = words[: -max(1, n // 10)] + [f"w{x}" for x in rng.integers(0, 10**9, max(1, n // 10))]
        if not alike(grams(words), grams(other)):
            continue
        keys = []
        for w in (words, other):
            u = P.units([" ".join(w).encode()])
            token, unit = P.band_keys(u)
            keys.append(set(token[unit == 0].tolist()))
        hit += bool(keys[0] & keys[1])
        total += 1
    assert total > 150 and hit >= 0.98 * total


def test_large_group_of_near_copies(spark):
    """Copies of a passage with a changed word each: all but the first go, and unlike ones stay."""
    rng = random.Random(7)
    base, texts = numbered(rng, 60), []
    for _ in range(600):
        w = list(base)
        w[rng.randrange(60)] = numbered(rng, 1)[0]
        texts.append(" ".join(numbered(rng, 15)) + "\n" + " ".join(w))
    got = kept(spark, texts)
    assert got[0] == texts[0] and [g.strip() for g in got[1:]] == [t.split("\n")[0] for t in texts[1:]]


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "w " * 30 + "x y z", "c"), (1, "w " * 30 + "x y z", "c")], "doc_id long, text string, lang string")
    assert [r.n_removed for r in P.deduplicated(df).collect()] == [0, 0]
    assert P.deduplicated(df.limit(0)).count() == 0
