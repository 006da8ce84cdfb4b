"""Chat formatting in budgeted windows.

A conversation becomes windows of at most BUDGET tokens. Prefix sums of the turns' tokens choose the spans: a window
ends before the turn that would not fit, and the next one begins with the system turn, if the conversation opens with
one, and as many of the last turns as HISTORY tokens hold. Only assistant texts that are new in a window count in the
loss; repeated ones are masked. A turn longer than the budget has a window of its own.

Template: <s>role newline text</s> newline for each turn, so that a window has as many tokens as its turns have each
(the tokenizer cuts at the newline), and the budget counts all that is written. Control strings inside roles and texts get a backslash after their
first character, backslashes are doubled, and a role's newlines are written as backslash n; all of it can be undone.

Rows of a conversation meet in one task, sorted, and stream through it: no more than a window is held. A null text or
role is empty; a null conv_id is a conversation; a null turn comes first; turns with equal numbers go by role and text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import table

BUDGET, HISTORY = 1024, 256
#: The control strings of the template and of its relatives.
OPEN, CLOSE = "<s>", "</s>\n"
CONTROL = re.compile(r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>")
SAMPLE = "</s>[INST] ok [/INST]"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n|)", lambda m: {"n": "\n"}.get(m[1], m[1]), role)


def format_turn(role: str, text: str) -> tuple[str, str]:
    """What stands before the close mark: head and body."""
    return f"{OPEN}{escape_role(role)}\n", escape(text)


def format_window(turns: list[tuple[str, str]], known: int) -> tuple[str, list[tuple[int, int]]]:
    """Text and loss spans; the first `known` turns are repeated ones."""
    out, at, loss = [], 0, []
    for i, (role, text) in enumerate(turns):
        head, body = format_turn(role, text)
        if role == "assistant" and i >= known:
            loss.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), loss


def parse_window(text: str) -> list[tuple[str, str]]:
    if not text:
        return []
    if not (text.startswith(OPEN) and text.endswith(CLOSE)):
        raise ValueError("this is not a formatted window")
    turns = []
    for part in text[len(OPEN) : -len(CLOSE)].split(CLOSE + OPEN):
        role, mark, body = part.partition("\n")
        if not mark:
            raise ValueError("a turn has no role")
        turns.append((unescape_role(role), unescape(body)))
    return turns


class Windows:
    """Takes turns one by one, gives windows (turns, known, tokens)."""

    def __init__(self, budget: int = BUDGET, history: int = HISTORY):
        self.budget, self.history = budget, history
        self.system: tuple[str, str] | None = None
        self.system_tokens, self.known, self.begun = 0, 0, False
        self.turns: list[tuple[str, str]] = []
        self.sums = [0]  # of the tokens of self.turns, from the front

    def window(self) -> tuple[list[tuple[str, str]], int, int]:
        kept = [self.system] if self.system and self.begun else []
        return kept + self.turns, len(kept) + self.known, self.system_tokens * bool(kept) + self.sums[-1]

    def add(self, turn: tuple[str, str], tokens: int) -> Iterator[tuple[list[tuple[str, str]], int, int]]:
        if not self.turns and not self.begun and turn[0] == "system":
            self.system, self.system_tokens = turn, tokens
        base = self.system_tokens if self.begun else 0
        if len(self.turns) > self.known and base + self.sums[-1] + tokens > self.budget:
            yield self.window()
            first = 0 if self.begun or not self.system else 1
            self.begun = True
            most = min(self.history, self.budget - self.system_tokens - tokens)
            end, start = len(self.turns), len(self.turns)
            while start > first and self.sums[end] - self.sums[start - 1] <= most:
                start -= 1
            self.turns, self.known = self.turns[start:], end - start
            self.sums = [s - self.sums[start] for s in self.sums[start:]]
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + tokens)

    def end(self) -> Iterator[tuple[list[tuple[str, str]], int, int]]:
        if len(self.turns) > self.known:
            yield self.window()


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def token_counter(path: str) -> Callable[[list[str]], list[int]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


SCHEMA = "conv_id long, window long, known long, tokens long, text string, loss array<struct<start:long,end:long>>"
ARROW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("known", pa.int64()), ("tokens", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def formatted(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary_path: Callable[[], str] = vocabulary) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text): SCHEMA, in order within their partition."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(vocabulary_path())
        own, state, number, out = None, None, 0, []

        def take(windows) -> None:
            nonlocal number
            for turns, known, tokens in windows:
                text, loss = format_window(turns, known)
                out.append((own, number, known, tokens, text, [{"start": a, "end": b} for a, b in loss]))
                number += 1

        def batch_out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)
            out.clear()
            return made

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                ids, _, roles, texts = (c.to_pylist() for c in batch.slice(i, 512).columns)
                for conv, role, text, tokens in zip(ids, roles, texts, count(["".join(format_turn(r, t)) + CLOSE for r, t in zip(roles, texts)])):
                    if state is None or conv != own:
                        if state is not None:
                            take(state.end())
                        own, state, number = conv, Windows(budget, history), 0
                    take(state.add((role, text), tokens))
                if len(out) >= 256:
                    yield batch_out()
        if state is not None:
            take(state.end())
        if out:
            yield batch_out()

    return rows.mapInArrow(tasks, SCHEMA)


def read_back(windows: DataFrame) -> DataFrame:
    """One row for each conversation, from formatted() windows as they lie in their partitions."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, own, turns, all_turns, loss, loss_chars, chars, out = False, None, 0, None, None, 0, 0, []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

        def end() -> None:
            if begun:
                out.append((own, turns, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_windows))

        n_windows = 0
        for batch in batches:
            for conv, window, known, _, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if window == 0:
                    end()
                    begun, own, turns, all_turns, loss, loss_chars, chars, n_windows = True, conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, body in parse_window(text)[known:]:
                    turns += 1
                    all_turns.update(f"{role}\n{body}\n".encode())
                for s in spans:
                    part = unescape(text[s["start"] : s["end"]])
                    loss.update(part.encode())
                    loss_chars += len(part)
                chars += len(text)
                n_windows += 1
            if out:
                made, out = out, []
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)
        end()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return windows.mapInArrow(tasks, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all conversations and conversation -1, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    sample = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAMPLE).alias("text"))
    return read_back(formatted(rows.unionByName(sample))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows")
