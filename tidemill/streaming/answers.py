"""Streams: framed events folded to answers, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def framed(chunks: DataFrame) -> DataFrame:
    """Whole server-sent events of streams (stream, seq, chunk): stream, place, data. Chunks are joined in order, so events
    may be cut anywhere; what follows the last blank line is not an event yet."""
    whole = chunks.groupBy("stream").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "chunk"))), lambda c: c["chunk"]), "").alias("body"))
    parts = F.split(F.regexp_replace("body", "\r\n?", "\n"), "\n\n")
    events = whole.select("stream", F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("place", "event"))
    lines = F.filter(F.split("event", "\n"), lambda x: x.startswith("data:"))
    return events.select("stream", "place", F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "^data: ?", "")), "\n").alias("data")).where("data <> ''")


def folded(events: DataFrame) -> DataFrame:
    """stream, text, finished: the deltas of events {"delta": ...} in order; {"done": true} ends an answer."""
    rows = events.select("stream", "place", F.get_json_object("data", "$.delta").alias("delta"), F.get_json_object("data", "$.done").alias("done"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("delta", F.lit("")).alias("delta")))), lambda c: c["delta"]), "")
    return rows.groupBy("stream").agg(text.alias("text"), F.bool_or(F.coalesce(F.col("done") == "true", F.lit(False))).alias("finished"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window; batch or stream. Rows later than `late` are left out of streams."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), "user_id", "n")
