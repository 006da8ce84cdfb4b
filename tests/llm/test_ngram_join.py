import random

import numpy as np
import pytest

from tidemill.llm import ngram_join as J
from tidemill.llm import shingles as S
from tidemill.llm.components import components


def brute(rows, k, percent):
    """component of each row by all pairs."""
    sets = []
    for _, text in rows:
        w = S.words_of(text)
        sets.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 30, 80, 150]))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary + ["New"])
        out.append((i * 3 % 1000, " ".join(w)))
    return out


@pytest.mark.parametrize("k,percent,group", [(5, 80, 32), (3, 90, 4)])
def test_against_all_pairs(spark, monkeypatch, k, percent, group):
    monkeypatch.setattr(J.candidates, "__defaults__", (J.ORDERS, group))
    monkeypatch.setattr(J.prefixes, "__defaults__", (group // 4,))
    rows = texts(k + percent, 260) + [(2000, ""), (2001, None), (2002, " \n"), (None, "only here " * 9), (None, None), (2003, "a"), (2004, "A"), (2005, "x " * 3000), (2006, "x " * 10)]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.joined(df, k, percent).collect()), key=repr)
    assert got == brute(rows, k, percent)


def test_real_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.op8_ngram_join(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == brute(rows, 3, 90)


def test_empty_table_and_kept_documents(spark):
    df = spark.createDataFrame([(3, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (2, "", "z"), (4, None, "z"), (None, "q r", "n"), (1, "a b c d e f g", "y"), (9, "Q R", "gone?")], "doc_id long, text string, component_id string")
    assert J.joined(df.limit(0)).count() == 0
    kept = J.kept_documents(df)
    assert kept.columns == df.columns and sorted(r.component_id for r in kept.collect()) == ["gone?", "y", "z", "z"]


def test_hot_candidates(spark):
    """All sets hang on one hot token, of which few are similar: leaders, then blocks, find all."""
    from tidemill.llm import pairs

    rows = texts(9, 200)
    sets = {S.set_id(s)[0]: s for s in (S.shingle_set(t, 3) for _, t in rows)}
    names = sorted(sets)
    held = spark.createDataFrame([(n, len(s), bytearray(s.tobytes())) for n, s in sets.items()], "item long, n int, values binary")
    star = spark.createDataFrame([(names[0], n, True) for n in names[1:]], "a long, b long, hot boolean")
    want = {frozenset(v) for v in by_component(spark.createDataFrame([(names[a], names[b]) for a, b in S.linked_pairs([sets[x] for x in names], None, 90)], "a long, b long")).values()}
    rare = np.zeros(J.BUCKETS, np.uint8)
    for screen in (None, lambda s: J.prefix_tokens(s, rare, 90)):
        got = {}
        for r in pairs.similar_components(star, held, 90, screen, block=7).collect():
            got.setdefault(r.component, set()).add(r.node)
        assert {frozenset(v) for v in got.values()} == want and len(want) > 3


def test_variants_that_are_not_similar(spark):
    """Hot candidates of which hardly any are similar: prefixes tell nearly all apart, blocks get what one shingle ties."""
    from tidemill.llm import pairs

    rng = random.Random(11)
    base, rows = [f"w{i}" for i in range(80)], []
    for i in range(300):
        w = list(base)
        for j in range(0, 80, 10):
            w[j] = f"x{rng.randrange(10**9)}"
        rows.append(" ".join(w))
        if i % 20 == 0:
            rows.append(" ".join(w[:-1] + ["end"]))
    sets = {S.set_id(s)[0]: s for s in (S.shingle_set(t, 5) for t in rows)}
    names = sorted(sets)
    held = spark.createDataFrame([(n, len(s), bytearray(s.tobytes())) for n, s in sets.items()], "item long, n int, values binary")
    members = spark.createDataFrame([(1, n, len(sets[n]), n) for n in names], "group long, item long, n int, piece long")
    want = {frozenset((names[a], names[b])) for a, b in S.linked_pairs([sets[x] for x in names], None, 80)}
    assert len(want) == 15
    assert {frozenset((r.a, r.b)) for r in pairs.left_over(members, held, pairs.common_shingles(members, held), 80, None, 256).collect()} == want
    assert J.candidates(pairs.group_prefixes(members, held, pairs.common_shingles(members, held), 80), 80, orders=1).count() < 60


def test_a_large_group_of_near_copies(spark):
    """Many copies of a text with some words changed each, whose links all hang on hot tokens."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(1500):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows.append((5000, " ".join(base[:100] + [f"y{i}" for i in range(100)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [S.shingle_set(t, 5) for _, t in rows]
    parent = list(range(len(rows)))
    for a, b in S.forest(S.linked_pairs(sets, None, 80)):
        root = lambda x: x if parent[x] == x else root(parent[x])
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = sorted((d, rows[root(i)][0]) for i, (d, _) in enumerate(rows))
    assert sorted((r.doc_id, r.component_id) for r in J.joined(df).collect()) == want


def by_component(links):
    out = {}
    for r in components(links).collect():
        out.setdefault(r.component, set()).add(r.node)
    return out


def test_linked_pairs_and_components(spark):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, rng.integers(0, 25)).astype(np.uint64)) for _ in range(60)]
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if len(sets[i]) and len(sets[j]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))]
    assert sorted(S.linked_pairs(sets, None, 60, columns=7)) == want
    assert sorted(S.linked_pairs(sets[:20], sets[20:], 60)) == [(i, j - 20) for i, j in want if i < 20 <= j]
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (300, 100), (7, 7), (500, 500)]
    got = by_component(spark.createDataFrame(chain, "a long, b long"))
    assert got == {0: set(range(61)), 100: {100, 200, 300}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_only_sets_of_pairs_are_shuffled(spark):
    from tidemill.llm import pairs

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64)) for _ in range(300)]
    sets[1] = sets[0]
    held = pairs.stored(spark.createDataFrame([(n, len(s), bytearray(s.tobytes())) for n, s in enumerate(sets)], "item long, n int, values binary"), "test-sets")
    met = spark.createDataFrame([(0, 1, False), (2, 3, False)], "a long, b long, hot boolean")
    context, jvm = spark.sparkContext, spark._jvm

    def sent():
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = sent()
    assert [tuple(r) for r in pairs.verified(met, held, 80).collect()] == [(0, 1)]
    assert sent() - before < 0.2 * sum(s.nbytes for s in sets)


def test_few_rounds_and_no_tables_left(spark):
    """What tasks and rounds leave is stars; links of one task need no round, and a round's tables go with it."""
    from tidemill.llm import components as C
    from tidemill.operators import stored

    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 4000, (2, 3000))
    node, least = C.stars(a, b)
    want = S.forest([(int(x), int(y)) for x, y in zip(a, b)])
    assert len(node) == len(want) and (least < node).all() and not set(node) & set(least) and len(set(node)) == len(node)
    links = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")
    for parts in (1, 7):
        begin = stored.mark()
        got = {(r.node, r.component) for r in components(links.repartition(parts)).collect() if r.node != r.component}
        assert got == set(zip(node.tolist(), least.tolist())) and len(stored._PATHS) - begin == 1
    assert C.are_stars(spark.createDataFrame([(5, 1), (6, 1), (9, 8)], "a long, b long"))
    assert not C.are_stars(spark.createDataFrame([(5, 1), (5, 2)], "a long, b long")) and not C.are_stars(spark.createDataFrame([(5, 3), (3, 1)], "a long, b long"))
    many = [(r.a, r.b) for r in C.thinned(links.coalesce(1), 100).collect()]
    assert sorted(map(sorted, by_component(spark.createDataFrame(many, "a long, b long")).values())) == sorted(map(sorted, by_component(links).values()))


def shuffled_rows(spark, df):
    """Rows that df's stages write to shuffles, and df's rows."""
    def written():
        none = spark._jvm.java.util.ArrayList()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return sum(x.shuffleWriteRecords() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages))

    begin = written()
    rows = df.collect()
    return written() - begin, rows


def test_near_copies_are_shuffled_as_groups(spark):
    """Sets that share most tokens are pairs once, not for each token and task."""
    tokens = [(t * 7919 * 32 + g, g * 100 + i, 300) for g in range(3) for t in range(200) for i in range(30) if (t + i) % 40]
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n, rows = shuffled_rows(spark, J.candidates(spark.createDataFrame(tokens, J.TOKEN), 80, orders=1))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted((r.a, r.b, r.hot) for r in rows) == [(g * 100 + i, g * 100 + j, False) for g in range(3) for i in range(30) for j in range(i + 1, 30)]
    assert n < 1.5 * len(tokens)


def test_long_sets_are_kept_as_texts(spark):
    """Long sets take half of their numbers' bytes at most, and are the same when read; short ones are numbers."""
    from tidemill.llm import pairs

    rng = random.Random(5)
    words = ["".join(rng.choice(["th", "er", "on", "in", "an", "de", "la"]) for _ in range(3)) for _ in range(2000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([5, 100, 600, 5000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = docs.selectExpr("doc_id AS item", "doc_id", "xxhash64(text) AS h", "0 AS start", "-1 AS length")
    held = {r.item: r for r in pairs.item_sets(items, docs, 3).collect()}
    for i, text in rows:
        want = S.shingle_set(text, 3)
        assert held[i].n == len(want) and (pairs.unpacked(bytes(held[i]["values"])) == want).all()
        assert len(held[i]["values"]) == 8 * len(want) if len(want) < 200 else 2 * len(held[i]["values"]) <= 8 * len(want)
