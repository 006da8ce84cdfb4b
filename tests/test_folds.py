"""Folds against a plain replay; any split of a log gives one state."""

import random

import pytest

from tidemill.operators import folds

SCHEMA = "key string, seq long, kind string, value string, rank int, target long"


def plain(log):
    """Replay: undos from the last one backwards, then each key's events in order."""
    void = set()
    for e in sorted(log, key=lambda e: -e[1]):
        if e[2] == "undo" and e[1] not in void:
            void.add(e[5])
    stacks = {}
    for key, seq, kind, value, rank, _ in sorted(log, key=lambda e: e[1]):
        if seq in void or kind == "undo":
            continue
        own = stacks.setdefault(key, {})
        if kind == "forget":
            own.clear()
        else:
            r, s, n = own.get(value, (-1, -1, 0))
            own[value] = (*max((r, s), (rank, seq)), n + 1)
    out = {}
    for key, own in stacks.items():
        if own:
            (v, (r, s, n)), *rest = sorted(own.items(), key=lambda x: x[1][:2], reverse=True)
            out[key] = (v, r, s, n, [x for x, _ in rest][:5])
    return out


def made(rng, n=400, horizon=None):
    log = []
    for seq in range(1, n + 1):
        kind = rng.choices(folds.KINDS, [12, 1, 4])[0]
        key, value = rng.choice("abcdefgh" + "h" * 20), f"v{rng.randrange(12)}"
        low = 1 if horizon is None or seq <= horizon + 1 else horizon + 1
        target = rng.randrange(low, seq) if seq > low and kind == "undo" else None
        log.append((None, seq, "undo", None, None, target) if target else (key, seq, "forget" if kind == "forget" else "learn", value if kind != "forget" else None, rng.randrange(4), None))
    return log


def states(df):
    return {r.key: (r.value, r["rank"], r.seq, r.uses, r.replaced) for r in df.collect()}


def test_state(spark):
    log = made(random.Random(1))
    got = states(folds.state(folds.sanitised(spark.createDataFrame(log, SCHEMA).repartition(5))))
    assert got == plain(log)


@pytest.mark.parametrize("upto", [1, 150, 399])
def test_snapshots(spark, upto):
    log = made(random.Random(upto), horizon=upto)
    rows = folds.sanitised(spark.createDataFrame(log, SCHEMA))
    kept = folds.snapshot(rows.where(f"seq <= {upto + 20}"), upto)
    assert kept.where(f"seq <= {upto}").count() <= 8 * 12
    assert states(folds.continued(kept, rows.where(f"seq > {upto + 20}"), upto)) == plain(log)


def test_sanitised(spark):
    rows = [("a", 1, "learn", "x", 99, None), ("a", 2, "learn", None, 1, None), (" ", 3, "learn", "x", 1, None), ("a", None, "learn", "x", 1, None), ("a", 4, "what", "x", 1, None), (None, 5, "undo", None, 1, 5), (None, 6, "undo", None, 1, None), ("b", 7, "learn", "y", None, None), ("a", 1, "learn", "z", 0, None), (None, 8, "forget", None, 0, None)]
    got = folds.sanitised(spark.createDataFrame(rows, SCHEMA)).orderBy("seq").collect()
    assert [(r.key, r.seq, r.value, r["rank"], r.n) for r in got] == [("a", 1, "x", 5, 1), ("b", 7, "y", 0, 1)]
    assert folds.state(folds.sanitised(spark.createDataFrame([], SCHEMA))).collect() == []


def test_domains(spark):
    log = [("Sales", 1, "learn", "what is sold", 2, None), ("Sales", 2, "learn", "weaker words", 1, None), ("Sales", 3, "learn", "all that is sold", 2, None), (None, 4, "undo", None, None, 3), ("Old", 5, "learn", "gone", 3, None), ("Old", 6, "forget", None, None, None)]
    members = spark.createDataFrame([("Sales", 1, "orders"), ("Sales", 2, "items"), ("Sales", 3, "carts"), ("Old", 5, "x")], "key string, seq long, table string")
    got = folds.domains(folds.sanitised(spark.createDataFrame(log, SCHEMA)), members).collect()
    assert [tuple(r) for r in got] == [("Sales", "what is sold", 2, ["items", "orders"])]


def test_runbook(spark):
    runs = [(1, "Top customers", "s1", "a", "who?"), (2, "top  Customers!", "s2", "b", "which?"), (3, "other", "s2", "c", "who?"), (4, "lone", "s9", "d", None), (5, "other", "s7", "e", None)]
    runs += [(10 + i, "lone", "s9", "d", f"q{i}") for i in range(12)]
    got = {r.id: r for r in folds.runbook(spark.createDataFrame(runs, "seq long, name string, shape string, sql string, question string")).collect()}
    assert set(got) == {"q1", "q4"}
    assert (got["q1"].name, got["q1"].sql, got["q1"].runs, got["q1"].questions) == ("other", "e", 4, ["who?", "which?"])
    assert got["q4"].questions == [f"q{i}" for i in range(11, 3, -1)]
