"""Markers that came back bent, and cuts that never split one.

A text that went through a model may bring a marker back with a letter too many, too few or changed. What is one edit away
from a marker is found by an automaton of the markers' grammar (kinds, the policy's tags, ids of pseudonyms) that counts
edits along; it starts only where the text still shows that a marker may begin, which any single edit leaves: both brackets,
or else the kind's name behind them. The nearest marker follows from its path. Ids that are damaged meet the vault's by a
join on what both are with one letter left out or none, and are compared then.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.privacy import policy
from tidemill.operators.privacy.protect import MARKER, ROW, numbered, replaced
from tidemill.operators.stored import apart, stored

#: A private-use character that no detector knows.
FILLER = "\ue000"
#: Lengths of pseudonyms, and the longest marker.
ID_LENGTHS, MOST_SHOWN, LONGEST = (6, 24), 24, 80
HEX, SHOWN = frozenset("0123456789abcdef"), frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_START = re.compile(r"\[\[|(?:pii|redacted|masked):")


# --- as columns ----------------------------------------------------------------------------------------------------


def _whole(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))


def places(text: Column) -> Column:
    """start and end of each well-formed marker of a text, in order."""
    both = F.arrays_zip(F.transform(F.split(text, MARKER), lambda x: F.length(x)).alias("gap"), F.transform(_whole(text), lambda x: F.length(x)).alias("size"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a, x):
        begin = a["at"] + x["gap"]
        one = F.when(x["size"].isNull(), F.array().cast("array<struct<start:int,end:int>>")).otherwise(F.array(F.struct(begin.alias("start"), (begin + x["size"]).alias("end"))))
        return F.struct((begin + F.coalesce(x["size"], F.lit(0))).alias("at"), F.concat(a["out"], one).alias("out"))

    return F.aggregate(both, start, step, lambda a: a["out"])


def covered(text: Column) -> Column:
    """The text with each well-formed marker replaced by filler of the same length, so that places stay."""
    filler = F.concat(F.transform(_whole(text), lambda x: F.repeat(F.lit(FILLER), F.length(x))), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(text, MARKER), filler, lambda a, b: F.concat(a, b)), "")


def safe_slice(text: Column, most: Column) -> Column:
    """At most `most` characters of the text; a marker that they would cut is left out whole."""
    head = F.substr(text, F.lit(1), most)
    out = F.when(F.length(text) <= most, text)
    for begins in (r"(\[\[[A-Za-z0-9_:]*\]?)$", r"(\[)$"):  # cut behind both its brackets, or between them
        begun = F.regexp_extract(head, begins, 1)
        start = F.length(head) - F.length(begun)
        whole = F.regexp_extract(F.substr(text, start + 1, F.lit(LONGEST)), "^" + MARKER, 0)
        out = out.when((begun != "") & (F.length(whole) > F.length(begun)), F.substr(text, F.lit(1), start))
    return out.otherwise(head)


def clipped(spans: Column, text: Column) -> Column:
    """Spans (start, end, ...) that reach into a marker end before it, without white space at the end; what begins in one,
    or has nothing before it, goes."""
    of = places(text)

    def end(s):
        hit = F.array_min(F.transform(F.filter(of, lambda m: (s["start"] < m["end"]) & (m["start"] < s["end"])), lambda m: m["start"]))
        return F.when(hit.isNull(), s["end"]).otherwise(s["start"] + F.length(F.rtrim(F.substr(text, s["start"] + 1, F.greatest(hit - s["start"], F.lit(0))))))

    return F.filter(F.transform(spans, lambda s: s.withField("end", end(s).cast("int"))), lambda s: s["end"] > s["start"])


# --- damaged ones --------------------------------------------------------------------------------------------------


class Grammar:
    """States and steps of the markers: steps[s] has (characters, what the nearest marker gets there, next state)."""

    def __init__(self):
        self.steps: list[list[tuple[frozenset, str, int]]] = [[]]
        self.end = self._new()
        tags = sorted({r[1] for r in policy.ROWS})
        for tag in tags:
            after = self._chain(self._chain(0, f"[[pii:{tag}:"), None, ID_LENGTHS[0])
            self._close(after)
            self._close(self._chain(after, None, ID_LENGTHS[1] - ID_LENGTHS[0]))
            self._close(self._chain(0, f"[[redacted:{tag}"))
            shown = self._chain(0, f"[[masked:{tag}")
            self._close(shown)
            at = self._chain(shown, ":")
            for _ in range(MOST_SHOWN):
                at = self._step(at, SHOWN, "?")
                self._close(at)

    def _new(self) -> int:
        self.steps.append([])
        return len(self.steps) - 1

    def _step(self, at: int, chars: frozenset, says: str) -> int:
        for c, _, to in self.steps[at]:
            if c == chars:
                return to
        to = self._new()
        self.steps[at].append((chars, says, to))
        return to

    def _chain(self, at: int, literal: str | None, n: int = 0) -> int:
        for c in literal or "?" * n:
            at = self._step(at, frozenset(c) if literal else HEX, c if literal else "?")
        return at

    def _close(self, at: int) -> None:
        self.steps[self._step(at, frozenset("]"), "]")].append((frozenset("]"), "]", self.end))

    def nearest(self, text: str, start: int, most: int = 1) -> tuple[int, int, int, str] | None:
        """(edits, matches, end, marker) of the marker that is nearest to what begins there: the fewest edits, then the most
        characters that match, then the shortest; none if it takes more than `most` edits. Its id is as found, with ? for
        what is no letter of one."""
        best = None
        active = {0: (0, 0, "")}  # state -> edits, matches (negative), marker

        def put(to: dict, state: int, value: tuple) -> None:
            if state not in to or value < to[state]:
                to[state] = value

        def skipped(of: dict) -> dict:
            """With what the text may lack."""
            todo = list(of)
            while todo:
                s = todo.pop()
                edits, matches, says = of[s]
                if edits < most:
                    for _, c, to in self.steps[s]:
                        value = (edits + 1, matches, says + c.replace("?", ""))
                        if to not in of or value < of[to]:
                            of[to] = value
                            todo.append(to)
            return of

        for i in range(start, min(len(text), start + LONGEST)):
            c, new = text[i], {}
            for s, (edits, matches, says) in skipped(active).items():
                for chars, shown, to in self.steps[s]:
                    if c in chars:
                        put(new, to, (edits, matches - 1, says + c))
                    elif edits < most:
                        put(new, to, (edits + 1, matches, says + shown))
                if edits < most and i > start:
                    put(new, s, (edits + 1, matches, says + c if c in HEX and any(x[1] == "?" for x in self.steps[s]) else says))
            active = new
            if not active:
                break
            ended = skipped(dict(active)).get(self.end)
            if ended and (best is None or ended[:2] < best[0]):
                best = (ended[:2], i + 1, ended[2])
        return best and (best[0][0], -best[0][1], best[1], best[2])


_GRAMMAR: list[Grammar] = []
_TAGS = {r[1] for r in policy.ROWS}
_PARTS = re.compile(r"\[\[(pii|redacted|masked):([A-Z_]+)(?::([0-9A-Za-z?]+))?\]\]")


def sound(m: re.Match) -> bool:
    """Whether what looks like a marker (_PARTS) is one: its tag is known, and its id is as long as ids are."""
    kind, tag, shown = m.groups()
    if tag not in _TAGS or (kind == "redacted") and shown:
        return False
    return len(shown or "") in ID_LENGTHS and HEX.issuperset(shown) if kind == "pii" else len(shown or "") <= MOST_SHOWN


def bent(text: str) -> list[tuple[int, int, str]]:
    """(start, end, nearest marker) of each place one edit away from a marker, apart from each other and from well-formed ones."""
    clear = _PARTS.sub(lambda m: FILLER * len(m[0]) if sound(m) else m[0], text)
    if not _GRAMMAR:
        _GRAMMAR.append(Grammar())
    starts = set()
    for m in _START.finditer(clear):
        if m[0] == "[[":
            starts.add(m.start())
        else:
            starts.update(range(max(0, m.start() - 3), m.start()))
    found = []
    for s in sorted(starts):
        near = _GRAMMAR[0].nearest(clear, s)
        if near and near[0]:
            found.append((-near[1], near[2] - s, s, near[3]))
    out: list[tuple[int, int, str]] = []
    # of those that overlap, the one of which the most matches, then the shortest
    for _, n, s, says in sorted(found):
        if all(s + n <= a or b <= s for a, b, _ in out):
            out.append((s, s + n, says))
    return sorted(out)


def damaged(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, start, end, found, kind, tag and id (? for what is no letter of one; null for redacted ones) of damaged markers."""
    names = ["start", "end", "found", "kind", "tag", "id"]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for s, e, says in bent(t):
                    at.append(i)
                    rows.append((s, e, t[s:e], *_PARTS.fullmatch(says).groups()))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int32(), pa.int32(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[key, *names])

    some = df.select(key, F.col(text).cast("string").alias(text)).where(F.col(text).rlike(_START.pattern))
    kind = dict(df.dtypes)[key]
    return some.mapInArrow(tasks, f"`{key}` {kind}, start int, end int, found string, kind string, tag string, id string")


def mended(df: DataFrame, vault: DataFrame, key: str, text: str = "text") -> DataFrame:
    """df, where damaged pseudonyms that can only be one of the vault's (identity, value, pseudonym) are that marker again;
    `restored` reads it then. Rows with null or repeated keys are rows of their own."""
    if key not in df.columns:
        raise ValueError(f"no column {key}")
    rows = numbered(df)
    found = stored(damaged(rows.select(ROW, text), ROW, text).where("kind = 'pii'"), "mended-found")
    known = vault.select(policy.looked_up(F.col("identity"), 1).alias("tag"), "pseudonym").distinct()
    # by hashes: what they confuse is told apart right after
    shorter = lambda c: F.explode(F.array_distinct(F.transform(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.overlay(c, F.lit(""), i, F.lit(1)))), lambda p: F.xxhash64("tag", p))))
    met = found.select(ROW, "start", "end", "tag", "id", shorter(F.col("id")).alias("part")).join(apart(known.select(F.col("tag").alias("__tag"), "pseudonym", shorter(F.col("pseudonym")).alias("part"))), "part")
    met = met.where((F.col("tag") == F.col("__tag")) & (F.levenshtein("id", "pseudonym", 1) >= 0))
    one = met.groupBy(ROW, "start", "end", "tag").agg(F.max(F.when(F.col("id") == F.col("pseudonym"), F.col("id"))).alias("same"), F.min("pseudonym").alias("least"), F.max("pseudonym").alias("most"))
    one = one.where("same IS NOT NULL OR least = most").withColumn("p", F.coalesce("same", "least"))
    new = F.concat(F.lit("[[pii:"), "tag", F.lit(":"), "p", F.lit("]]"))
    changes = one.select(ROW, F.struct("start", "end", new.alias("new")).alias("c")).groupBy(ROW).agg(F.sort_array(F.collect_list("c")).alias("__changes"))
    back = F.when(F.col("__changes").isNull(), F.col(text)).otherwise(replaced(F.col(text), F.col("__changes")))
    return rows.join(apart(changes), ROW, "left").withColumn(text, back).select(*[F.col(f"`{c}`") for c in df.columns])
