from collections import Counter, defaultdict

from tidemill.llm import mixing
from pyspark.sql import functions as F


def shares(sizes: dict) -> dict:
    """By the words of the contract: share by weight, stop at 3 times, reshare the excess."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = sum(sizes.values())
    target, full = {s: 0.0 for s in order}, set()
    left = total
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(weight[f] for f in free) for s in order}
        above = {s for s in free if target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


def test_permutation(spark):
    for n in (1, 2, 3, 7, 64, 101):
        df = spark.range(n).withColumn("n", F.lit(n).cast("long"))
        got = df.select("id", mixing.permuted(F.col("id"), F.col("n"), F.lit(4)).alias("p")).select("id", "p", mixing.permuted(F.col("p"), F.lit(n).cast("long"), F.lit(4), back=True).alias("b")).collect()
        assert sorted(r.p for r in got) == list(range(n)) and all(r.b == r.id for r in got)


def check(docs, rows):
    sizes = defaultdict(int)
    for _, source, text in docs:
        sizes[source] += len((text or "").split())
    target = shares(dict(sizes))
    by_target = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
    for s in sizes:
        own = [r for r in rows if abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s]]
        assert own
        by_target[(sizes[s], round(target[s], 6))] = sum(r.taken for r in own)
    expected = Counter()
    for s in sizes:
        expected[(sizes[s], round(target[s], 6))] += int(target[s] + 1e-6)
    assert by_target == dict(expected)


def run(spark, tmp_path, docs):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.mode("overwrite").parquet(path)
    return mixing.op3_mixing(spark, str(tmp_path)).collect()


def test_small_cases(spark, tmp_path):
    docs = [(i, f"s{i % 5}" if i % 11 else None, "w " * (i * 7 % 400)) for i in range(200)]
    docs += [(500, "s0", None), (500, "s0", None), (501, "big", "x " * 30_000), (None, "s1", "a b c"), (7, "s1", "same words"), (7, "s1", "same words")]
    first = run(spark, tmp_path, docs)
    assert len(first) == len(docs)
    check(docs, first)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(first, key=key) == sorted(run(spark, tmp_path, docs[::-1]), key=key)


def test_one_document_and_none(spark, tmp_path):
    rows = run(spark, tmp_path, [(1, "a", "one two three")])
    assert [(r.size, r.taken) for r in rows] == [(3, 3)]
    assert run(spark, tmp_path, [(1, "a", ""), (2, None, None)])[0].taken == 0


def test_empty(spark, tmp_path):
    spark.range(0).selectExpr("id doc_id", "'' source", "'' text").write.parquet(str(tmp_path / "documents.parquet"))
    assert mixing.op3_mixing(spark, str(tmp_path)).count() == 0


def test_texts_hold_what_is_taken(spark, tmp_path):
    docs = [(i, f"s{i % 3}", " ".join(f"d{i}w{j}" for j in range(i % 50 * 9))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("pass", F.lit("mine"))
    got = mixing.mixed_texts(df, block=32).collect()
    words = Counter(w for r in got for w in r.text.split())
    per_doc = Counter(r.doc_id for r in got)
    taken = {r.doc_id: r.taken for r in run(spark, tmp_path, docs)}
    assert max(words.values()) <= 3 and max(per_doc.values()) <= 3 and all(len(r.text) == r.n_chars and r["pass"] == "mine" for r in got)
    sizes = {i: len(t.split()) for i, _, t in docs}
    assert sum(words.values()) == sum(taken.values()) <= sum(sizes.values())
