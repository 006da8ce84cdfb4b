"""Tables of separated values inside texts.

A table begins at a line that can be a header: two names or more, apart by one of DELIMITERS, of which a column's name tells
what it holds. The delimiter is the one whose header has as many fields as most of the lines that follow. Rows go on as long as they
have the header's number of fields, quotes are closed, and no blank line comes; a quoted field may hold delimiters, line
ends and doubled quotes. Values are typed by their column's name; quotes around them are not part of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.privacy.values import name_class

DELIMITERS = ",;\t|"
MOST_FIELD, LOOK = 4000, 3
_NAME = re.compile(r"[ \t]*(?:\"[^\"\n]{1,60}\"|[A-Za-z_][\w .-]{0,59}?)[ \t]*\Z")


def record(text: str, at: int, delimiter: str) -> tuple[list[tuple[int, int]], int] | None:
    """(first and last place of each field, where the next record begins) of the record that begins at a place; none if a
    quote is left open or something follows a closed one."""
    fields, n = [], len(text)
    while True:
        start = at
        while start < n and text[start] in " \t" and text[start] != delimiter:
            start += 1
        if start < n and text[start] == '"':
            end = start + 1
            while True:
                end = text.find('"', end, start + MOST_FIELD)
                if end < 0:
                    return None
                if text[end + 1 : end + 2] != '"':
                    break
                end += 2
            fields.append((start + 1, end))
            at = end + 1
            while at < n and text[at] in " \t" and text[at] != delimiter:
                at += 1
        else:
            at = start
            while at < n and text[at] != delimiter and text[at] not in "\r\n":
                at += 1
            end = at
            while end > start and text[end - 1] in " \t":
                end -= 1
            fields.append((start, end))
        if at < n and text[at] == delimiter:
            at += 1
            continue
        if at < n and text[at] not in "\r\n":
            return None
        if text[at : at + 2] == "\r\n":
            at += 1
        return fields, min(at + 1, n)


def _table(text: str, at: int) -> tuple[list[str | None], list[list[tuple[int, int]]], int] | None:
    """(each column's type, the rows' fields, where it ends) of the table whose header begins at a place."""
    end = text.find("\n", at)
    line = text[at : len(text) if end < 0 else end]
    best = None
    for delimiter in DELIMITERS:
        if delimiter not in line:
            continue
        head = record(text, at, delimiter)
        if head is None or len(head[0]) < 2 or not all(_NAME.match(text[a:b]) or _NAME.match(f'"{text[a:b]}"') for a, b in head[0]):
            continue
        kinds = [name_class(text[a:b]) for a, b in head[0]]
        if not any(kinds):
            continue
        rows, place = [], head[1]
        while place < len(text):
            row = record(text, place, delimiter)
            if row is None or len(row[0]) != len(kinds):
                break
            rows.append(row[0])
            place = row[1]
        if rows and (best is None or (min(len(rows), LOOK), len(kinds)) > (min(len(best[1]), LOOK), len(best[0]))):
            best = kinds, rows, place
    return best


def values(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the typed values of all tables in a text, in order. Empty values are none."""
    out, at = [], 0
    while at < len(text):
        found = _table(text, at)
        if found:
            kinds, rows, at = found
            out += [(a, b, kind) for row in rows for (a, b), kind in zip(row, kinds) if kind and b > a]
            continue
        end = text.find("\n", at)
        if end < 0:
            break
        at = end + 1
    return out


def csv_values(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, start, end, type, value of the typed values of tables in texts. Only texts with a delimiter and a line's end are read."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for a, b, kind in values(t):
                    at.append(i)
                    rows.append((a, b, kind, t[a:b]))
            columns = list(zip(*rows)) or [[]] * 4
            types = [pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, types)]], names=[key, "start", "end", "type", "value"])

    some = df.select(key, F.col(text).cast("string").alias(text)).where(F.col(text).rlike("[,;\t|][^\n]*\n"))
    kind = dict(df.dtypes)[key]
    return some.mapInArrow(tasks, f"`{key}` {kind}, start int, end int, type string, value string")
