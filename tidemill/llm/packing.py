"""Packing: cost-balanced sequences of tokens.

Each task packs the documents of its partition in chunks of about CHUNK_TOKENS tokens, so nothing is shuffled and a
chunk's memory is bounded. A chunk of n tokens gets n // size full sequences and, for the rest, sequences whose
lengths are the powers of two that add up to it, so no position is padded. Documents go in by descending length, each
to the sequence with the least cost so far that has room, where the cost of a piece of m tokens is linear * m +
quadratic * m * m (attention stays within a document). What fits nowhere whole is cut: it fills the sequence with the
most room, and the rest goes on as a shorter document.
"""

from __future__ import annotations

import heapq
import math
import os
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, END_ID, CHUNK_TOKENS = 2048, 1, 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
CACHE_WORDS = 400_000
NONE = (math.inf, -1, 0)


def capacities(total: int, size: int = SIZE) -> list[int]:
    """Full sequences, then powers of two for what is left; together exactly total."""
    rest = total % size
    return [size] * (total // size) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], size: int = SIZE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece. Documents of no tokens have no piece."""
    room = capacities(sum(lengths), size)
    used = [0] * len(room)
    pieces = []

    def put(doc: int, start: int, n: int, seq: int) -> None:
        pieces.append((doc, start, n, seq, used[seq]))
        used[seq] += n
        room[seq] -= n

    full = 0
    todo = []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= size:  # whole sequences of one document
            put(doc, start, size, full)
            full += 1
            start += size
        if n > start:
            todo.append((start - n, doc, start))
    heapq.heapify(todo)  # longest first; ties by document
    open_ = Open(size)
    for seq in range(full, len(room)):
        open_.add(room[seq], 0.0, seq)
    while todo:
        n, doc, start = heapq.heappop(todo)
        n = -n
        # if none has room for all of it, the one with the most room takes what it can
        at = open_.cheapest(n) or open_.roomiest()
        cost, seq = open_.take(at)
        m = min(n, room[seq])
        put(doc, start, m, seq)
        if m < n:
            heapq.heappush(todo, (m - n, doc, start + m))
        if room[seq]:
            open_.add(room[seq], cost + linear * m + quadratic * m * m, seq)
    return pieces


class Open:
    """Sequences with room: a heap by cost for each room, and a tree of the least of each range of rooms."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.leaves)]
        self.tree = [NONE] * (2 * self.leaves)

    def _changed(self, room: int) -> None:
        i, heap = self.leaves + room, self.heaps[room]
        self.tree[i] = (*heap[0], room) if heap else NONE
        while i > 1:
            i //= 2
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def add(self, room: int, cost: float, seq: int) -> None:
        heapq.heappush(self.heaps[room], (cost, seq))
        self._changed(room)

    def cheapest(self, n: int) -> int:
        """The room of the sequence of least cost (ties: least number) that has room for n; 0 if there is none."""
        i = self.leaves + n
        best = self.tree[i]
        while i > 1:
            if i % 2 == 0:
                best = min(best, self.tree[i + 1])
            i //= 2
        return best[2]

    def roomiest(self) -> int:
        i = 1
        while i < self.leaves:
            i = 2 * i + (self.tree[2 * i + 1] is not NONE)
        return i - self.leaves

    def take(self, room: int) -> tuple[float, int]:
        """The cheapest sequence with exactly this room goes out: its cost and number."""
        out = heapq.heappop(self.heaps[room])
        self._changed(room)
        return out


#: Punctuation that is apart from a letter before it (an apostrophe may not be).
_ENDS = b".,!?;:#$%&|*<>()-"
#: How byte-level vocabularies write bytes as letters: printable ones stand for themselves, others follow from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_AS_LETTERS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


class WordTokens:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and never joins over it, so a text's ids are those of its words, which repeat;
    up to CACHE_WORDS of them are remembered. A letter and the punctuation at the word's end are always apart too.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        known, stems, cut, bytes_of = self.known, set(), {}, self.bytes_of
        tokenize = self.tokenizer.model.tokenize
        for w in words:
            if w.islower() and w.isalpha():  # ASCII letters, the most frequent case
                known[w] = b"".join([bytes_of[t.id] for t in tokenize(w.decode())])
                continue
            s = w.rstrip(_ENDS)
            if s != w and s and (s[-1:].isalpha() or s[-1] >= 0x80 and s.decode()[-1].isalpha()) and b"<|" not in w:
                end = w[len(s) :]
                cut[w] = s, end
                stems.add(s)
                stems.add(end)
            else:
                stems.add(w)
        rest, texts = [], []
        for s in stems:
            if s in known:
                continue
            text = s.decode()
            # letters that no normalizer changes are one piece of the vocabulary's first cut
            if text.isalpha() and text == text.lower() and (text.isascii() or unicodedata.is_normalized("NFC", text)):
                known[s] = b"".join([bytes_of[t.id] for t in tokenize(text if text.isascii() else s.decode("latin-1").translate(_AS_LETTERS))])
            else:
                rest.append(s)
                texts.append(text)
        for s, e in zip(rest, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []):
            known[s] = array("I", e.ids).tobytes()
        for w, (s, end) in cut.items():
            known[w] = known[s] + known[end]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, out = self.known, []
        for t in texts:  # one by one: a text's words are near at hand still when they are looked up
            raw = (t or "").encode()
            # lower case early where no special token's string can come of it
            words = (raw if b"<|" in raw else raw.lower()).split()
            ids = list(map(known.get, words))
            if None in ids:
                self.learn({w for w, x in zip(words, ids) if x is None})
                ids = map(known.__getitem__, words)
            out.append(b"".join(ids))
        return out


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """A worker's tokens: the words that a task has met are known to the next one."""
    return WordTokens(path)


def packed(docs: DataFrame, vocabulary: str | Callable[[], str], size: int = SIZE, end_id: int = END_ID, ids: bool = True, keep: bool = True) -> DataFrame:
    """Pieces of documents (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the token ids if wanted.

    Null text counts as empty (the end id alone). Repeated rows are documents of their own. Sequences are numbered by
    partition and within it, alike when a task runs again. An empty table has no pieces. Without `keep` a task forgets the
    words that it met, where the worker goes on with other operators' work.
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(vocabulary() if callable(vocabulary) else vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 36
        held: list[tuple[int | None, bytes]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, count
            pieces = pack([len(b) // 4 for _, b in held], size)
            rows = []
            for doc, start, n, seq, offset in pieces:
                doc_id, data = held[doc]
                own = data[4 * start : 4 * (start + n)]
                rows.append((doc_id, start, n, zlib.crc32(own), len(data) // 4, number + seq, offset) + ((own,) if ids else ()))
            number += max((p[3] for p in pieces), default=-1) + 1
            held, count = [], 0
            cols = list(zip(*rows))
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            if ids:
                arrays.append(pa.array(cols[7], pa.binary()))
            return pa.RecordBatch.from_arrays(arrays, names=NAMES[: len(arrays)])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for doc_id, data in zip(part.column(0).to_pylist(), tokens(part.column(1).to_pylist())):
                    held.append((doc_id, data + end))
                    count += len(data) // 4 + 1
                    if count >= CHUNK_TOKENS:
                        yield flush()
        if held:
            yield flush()
        if not keep:
            word_tokens.cache_clear()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tasks, schema)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def word_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents packed; the ids themselves are left out, their CRC stands for them."""
    from tidemill.llm.common import table

    return packed(table(spark, sf_dir, "documents"), word_vocabulary, ids=False)
