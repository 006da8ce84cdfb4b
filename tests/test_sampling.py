from collections import Counter

from tidemill.operators import sampling


def test_samples_are_the_same_whenever_drawn(spark):
    rows = [(i, "hot" if i % 3 else None if i % 7 == 0 else f"s{i % 11}", float(i % 50), i % 5) for i in range(3000)] + [(None, "x", 1.0, 0)]
    df = spark.createDataFrame(rows, "id long, s string, w double, more int")
    for draw in (
        lambda d: sampling.bernoulli(d, "id", 0.1, "a"),
        lambda d: sampling.weighted(d, "id", "w", 100, "a"),
        lambda d: sampling.stratified(d, "id", "s", 9, "a"),
    ):
        one = sorted(map(repr, draw(df.repartition(7)).collect()))
        assert one == sorted(map(repr, draw(df.repartition(2, "more")).collect())) and one
    ids = lambda f, seed: {r.id for r in sampling.bernoulli(df, "id", f, seed).collect()}
    assert ids(0.1, "a") < ids(0.3, "a") and ids(0.1, "a") != ids(0.1, "b") and 230 < len(ids(0.1, "a")) < 370
    assert len(ids(1.0, "a")) == 3001 and not ids(0.0, "a")
    n = Counter(r.s for r in sampling.stratified(df, "id", "s", 9, "a").collect())
    assert n == {s: min(9, c) for s, c in Counter(r[1] for r in rows).items()}


def test_weighted_estimates(spark):
    df = spark.createDataFrame([(i, float(1 + i % 100)) for i in range(5000)] + [(9000, None), (9001, 0.0), (9002, -1.0)], "id long, w double")
    total = sum(1 + i % 100 for i in range(5000))
    sums = []
    for seed in "abcdefgh":
        got = sampling.weighted(df, "id", "w", 400, seed).collect()
        assert len(got) == 400 and all(r.w > 0 for r in got)
        sums.append(sum(r.estimate for r in got))
    assert abs(sum(sums) / 8 / total - 1) < 0.05
    few = sampling.weighted(df, "id", "w", 9999, "a").collect()
    assert len(few) == 5000 and sum(r.estimate for r in few) == total
