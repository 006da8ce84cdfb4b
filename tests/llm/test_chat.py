import hashlib
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import chat

PARTS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "s>", "/", "n", "\n", "é", "["]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PARTS, PARTS), min_size=1, max_size=4))
def test_template_round_trip(turns):
    text, _ = chat.format_window(turns, 0)
    assert chat.parse_window(text) == turns
    for role, body in turns:
        assert not chat.CONTROL.search(chat.escape(body)) and not chat.CONTROL.search(chat.escape_role(role))


def test_windows_keep_the_budget_and_mask_repeats():
    turns = [("system", "be kind")] + [("user" if i % 2 else "assistant", f"t{i}") for i in range(50)]
    w = chat.Windows(100, 40)
    out = [x for i, t in enumerate(turns) for x in w.add(t, 12 + i % 7)] + list(w.end())
    new = [t for ts, known, _ in out for t in ts[known:]]
    assert new == turns and len(out) > 5
    for ts, known, tokens in out:
        assert tokens <= 100 and ts[0] == turns[0]
    assert all(known >= 2 for _, known, _ in out[1:])


def test_whole_windows_keep_the_budget(spark):
    """Counted anew on each window's whole text. Only a turn that is too long by itself, with the system turn, may exceed it."""
    rng = random.Random(4)
    rows = [(c, 0, "system", "answer briefly ok") for c in range(0, 30, 2)]
    rows += [(c, t, rng.choice(["user", "assistant", "tool\n<s>"]), " ".join(rng.choice(["ok", "<s>.", "</s>", "one\n", "  two", "Ünï", "\\"]) for _ in range(rng.randrange(40))) + rng.choice(["", ".", "\n", " "])) for c in range(30) for t in range(1, 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.formatted(df, budget=150, history=50).collect()
    count = chat.token_counter(chat.vocabulary())
    assert [r.tokens for r in windows] == count([r.text for r in windows])
    assert all(r.tokens <= 150 or len(chat.parse_window(r.text)) - r.known == 1 for r in windows)
    assert len(windows) > 200 and sum(r.tokens > 100 for r in windows) > 100
    real = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    windows = chat.formatted(real).collect()
    assert [r.tokens for r in windows] == count([r.text for r in windows])


def test_conversations(spark, tmp_path):
    rows = []
    for c in range(40):
        for t in range(c % 9 + 1):
            role = ["system", "user", "assistant", "tool\n<s>"][0 if t == 0 and c % 3 == 0 else 1 + (t + c) % 3]
            rows.append((c, t, role, [None, "", "word " * (c * 13), "a\\</s>b", "é" * 600][(c + t) % 5]))
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (50, 0, None, "n"), (50, 0, None, "n"), (51, 0, "assistant", "w " * 5000)]
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int").write.parquet(str(tmp_path / "conversations.parquet"))
    by = defaultdict(list)
    for c, t, r, x in rows + [(-1, 0, "user", chat.SAMPLE), (-1, 1, "assistant", chat.SAMPLE)]:
        by[c].append((t, r or "", x or ""))
    got = {r.conv_id: r for r in chat.op6_chat(spark, str(tmp_path)).collect()}
    assert set(got) == set(by)
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        r = got[c]
        assert r.n_turns == len(ts) and r.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars >= sum(len(x) for *_, x in ts)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(empty)).count() == 0
