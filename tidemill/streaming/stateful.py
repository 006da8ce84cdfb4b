"""Streams read piece by piece: events are framed as their chunks come, and text is given on without
ever cutting a marker.

Each stream has a state between micro-batches: what follows its last whole event, the text that may be the beginning of a
marker, chunks that came before their predecessors, and the number of the next chunk: one value, which is read once and
written once for each stream of a batch, as each access is a call from Python to the store. It is dropped when the stream's last
event comes; that of a stream which never ends expires, if `expires_ms` is set. Whatever the cuts, batches and order of chunks, the pieces of a
stream make what its whole body makes (`answers.framed` and `answers.folded`).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: More than the longest marker that is written; what runs on longer is none.
MOST_HELD, EXPIRES_MS = 64, 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PIECES = "stream string, place long, text string, finished boolean"
_BEGUN = re.compile(r"\[(?:\[(?:[a-z]+(?::[A-Za-z0-9_:]*\]?)?)?)?\Z")


def held_back(text: str) -> int:
    """How many characters at the end may be the beginning of a marker."""
    m = _BEGUN.search(text, max(0, len(text) - MOST_HELD))
    return len(text) - m.start() if m else 0


def cut_events(buffer: str) -> tuple[list[str], str]:
    """The data of whole events, and what follows them. A carriage return at the end may be half of a line's end, and waits."""
    end = len(buffer) - buffer.endswith("\r")
    *blocks, rest = re.sub("\r\n?", "\n", buffer[:end]).split("\n\n")
    out = []
    for block in blocks:
        lines = [line[5:].removeprefix(" ") for line in block.split("\n") if line.startswith("data:")]
        if lines:
            out.append("\n".join(lines))
    return out, rest + buffer[end:]


def delta(data: str) -> tuple[str, bool]:
    """An event's text, and whether it ends the stream. What is no object of JSON has neither."""
    try:
        event = json.loads(data)
    except ValueError:
        return "", data.strip() == "[DONE]"
    if not isinstance(event, dict):
        return "", False
    text = event.get("delta")
    return text if isinstance(text, str) else "", event.get("done") is True


class Answers(StatefulProcessor):
    """Chunks (stream, seq, chunk) of a stream to PIECES."""

    def __init__(self, expires_ms: int | None = None):
        self.expires_ms = expires_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next long, place long, rest string, held string, early string", self.expires_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        come: dict[int, str] = {}
        for row in rows:
            come.setdefault(row["seq"], row["chunk"] or "")
        known = self.at.get()
        number, place, rest, held, early = known or (0, 0, "", "", "")
        waiting = dict(json.loads(early)) if early else {}
        for seq, chunk in come.items():  # those before `number` have been read
            if seq >= number:
                waiting.setdefault(seq, chunk)
        out, done = [], False
        while number in waiting and not done:
            events, rest = cut_events(rest + waiting.pop(number))
            number += 1
            for data in events:
                text, done = delta(data)
                text = held + text
                n = 0 if done else held_back(text)
                text, held = text[: len(text) - n], text[len(text) - n :]
                if text or done:
                    out.append(Row(stream=key[0], place=place, text=text, finished=done))
                    place += 1
                if done:
                    break
        if not done:
            self.at.update((number, place, rest, held, json.dumps(list(waiting.items())) if waiting else ""))
        elif known:
            self.at.clear()
        yield from out

    def close(self) -> None:
        pass


def pieces(chunks: DataFrame, expires_ms: int | None = EXPIRES_MS) -> DataFrame:
    """PIECES of a streaming table of chunks (stream: string, seq: 0, 1, 2, ..., chunk). Rows that come twice count once; a
    null chunk is empty, and rows without a stream or number are left out. The session's state store must be ROCKS. State
    that expires needs a clock, so a run over what is there (trigger availableNow) takes None: it would never end."""
    return (
        chunks.select(chunks["stream"].cast("string").alias("stream"), chunks["seq"].cast("long").alias("seq"), chunks["chunk"].cast("string").alias("chunk"))
        .where("seq IS NOT NULL AND stream IS NOT NULL")
        .groupBy("stream")
        .transformWithState(Answers(expires_ms), outputStructType=PIECES, outputMode="Append", timeMode="None" if expires_ms is None else "ProcessingTime")
    )


def streamed(folder: str, schema: str, chunks_folder: str, spark, files: int = 4) -> DataFrame:
    """The pieces of all chunks in a folder of Parquet files, read as a stream of `files` files a batch, written to `folder`."""
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(chunks_folder)
        run = pieces(rows, None).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/pieces").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return spark.read.schema(PIECES).parquet(f"{folder}/pieces")
