import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemill.llm import packing


def test_pack_covers_every_token_once():
    rng = random.Random(1)
    for lengths in ([], [1], [2048], [5000, 3, 0, 2047, 2048], [rng.randint(0, 6000) for _ in range(400)], [7] * 3000):
        pieces = packing.pack(lengths)
        got, sequences = defaultdict(list), defaultdict(list)
        for doc, start, n, seq, offset in pieces:
            assert n > 0
            got[doc].append((start, n))
            sequences[seq].append((offset, n))
        for doc, n in enumerate(lengths):
            at = 0
            for start, m in sorted(got[doc]):
                assert start == at
                at += m
            assert at == n
        for s in sequences.values():
            at = 0
            for offset, m in sorted(s):
                assert offset == at
                at += m
            assert at == 2048 or at & (at - 1) == 0 and at < 2048


def test_costs_are_balanced():
    rng = random.Random(2)
    lengths = [rng.randint(20, 700) for _ in range(4000)]
    cost = defaultdict(float)
    for _, _, n, seq, _ in packing.pack(lengths):
        cost[seq] += packing.LINEAR * n + packing.QUADRATIC * n * n
    full = sorted(cost.values())[20:]
    assert full[-1] < 2.0 * full[0]


def plainly_packed(lengths, size):
    """Each document by descending length to the cheapest of all sequences that have room, looked for one by one."""
    room = packing.capacities(sum(lengths), size)
    used, cost, out = [0] * len(room), [0.0] * len(room), []
    todo = sorted(((n % size, d, n - n % size) for d, n in enumerate(lengths) if n % size), key=lambda x: (-x[0], x[1]))
    full = 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % size, size):
            out.append((d, start, size, full, 0))
            room[full] = 0
            full += 1
    while todo:
        n, d, start = todo.pop(0)
        fits = [s for s in range(full, len(room)) if room[s] >= n]
        s = min(fits, key=lambda s: (cost[s], s)) if fits else max(range(full, len(room)), key=lambda s: (room[s], -cost[s], -s))
        m = min(n, room[s])
        out.append((d, start, m, s, used[s]))
        used[s], room[s], cost[s] = used[s] + m, room[s] - m, cost[s] + packing.LINEAR * m + packing.QUADRATIC * m * m
        if m < n:
            todo = sorted([*todo, (n - m, d, start + m)], key=lambda x: (-x[0], x[1], x[2]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_every_piece_goes_to_the_cheapest_sequence_with_room(seed):
    rng = random.Random(seed)
    lengths = [max(1, int(rng.lognormvariate(3.5, 1.2))) for _ in range(700)] + [0, 256, 600]
    assert sorted(packing.pack(lengths, 256)) == sorted(plainly_packed(lengths, 256))


def test_words_give_the_ids_of_the_whole_text(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.word_vocabulary())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["", "It's THE end.,. of<|endoftext|>x. <|ENDOFTEXT|> ok", "İ İ é x y. \x1c z", "a.b,c... 12.5 (x). é.", "ΣΣ αΣ. '"]
    words = packing.WordTokens(packing.word_vocabulary())
    for text, got in zip(texts, words(texts)):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_packed_table(spark):
    rows = [(1, "one two", "x"), (2, None, None), (3, "word " * 9000, "y"), (1, "one two", "x"), (None, "null id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    out = packing.packed(df.coalesce(1), packing.word_vocabulary).collect()
    assert sum(r.length for r in out if r.start == 0 and r.doc_id == 2) == 1
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert sum(r.length for r in out if r.doc_id == 3) == 9001
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
    assert packing.packed(df.limit(0), packing.word_vocabulary).count() == 0


@pytest.mark.parametrize("total", [0, 1, 2047, 2048, 5000])
def test_capacities(total):
    assert sum(packing.capacities(total)) == total
