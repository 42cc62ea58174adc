"""Conversations as training texts: windows of whole turns within a token budget.

A turn is ``<turn role="...">``, its text and ``</turn>``, each on lines of its own. Inside
a text every ``<turn`` and ``</turn``, with the backslashes before it, gets one backslash
more; taking one away gives the text back. Turns are put into windows by prefix sums of
their tokens. Each window after the system turn begins with it, then repeats the last few
turns before its own; of what is repeated nothing is under the loss mask, which covers the
assistant's texts of the window's own turns.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnflow.llm.common import staged, table
from kilnflow.operators.ordered import CHUNK, SPLIT, cut

#: Tokens of a window, of them at most so many repeated before its own turns, and those of a
#: turn's markers.
BUDGET = 1024
HISTORY = 256
MARKERS = 4
TARGET = "assistant"
SYSTEM = "system"

_TOKEN = re.compile(r"\w+|[^\w\s]")
_CONTROL = re.compile(r"\\*</?turn")
_ESCAPED = re.compile(r"\\(\\*</?turn)")
_HEADER = re.compile(r'<turn role=("(?:[^"\\]|\\.)*")>\n')
_END = "\n</turn>\n"

#: Where a row stands in its part: repeated from earlier parts, or its own.
_SYSTEM_ROW, _HISTORY_ROW, _OWN_ROW = 0, 1, 2
_WINDOWS_AT_ONCE = 256

_WINDOW = (
    "conv_id long, part long, split boolean, window long, text string, fresh_from long, "
    "targets array<struct<start:long,end:long>>, tokens long"
)


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda found: "\\" + found.group(), text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def token_count(text: str) -> int:
    """Words and signs of a turn, and its markers."""
    return sum(1 for _ in _TOKEN.finditer(text)) + MARKERS


class Turn:
    """One turn, formatted; ``start`` and ``end`` are where its escaped text is."""

    __slots__ = ("end", "formatted", "role", "start", "tokens")

    def __init__(self, role: str, text: str) -> None:
        header = f"<turn role={json.dumps(role, ensure_ascii=False)}>\n"
        body = escaped(text)
        self.role, self.tokens = role, token_count(text)
        self.start, self.end = len(header), len(header) + len(body)
        self.formatted = header + body + _END


class Part:
    """The windows of a run of turns of one conversation, as the turns come in order.

    Keeps the turns of the window to come, those that may be repeated, and the system turn.
    """

    def __init__(self, budget: int, history: int) -> None:
        self.budget, self.limit = budget, history
        self.system: Turn | None = None
        self.past: list[Turn] = []
        self.turns: list[Turn] = []
        self.sums = [0]

    def repeat(self, turn: Turn) -> None:
        """A turn from before this part."""
        self._follow([turn])

    def add(self, turn: Turn) -> Iterator[tuple]:
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + turn.tokens)
        while self.turns and self.sums[-1] > self._room():
            yield self._window()

    def rest(self) -> Iterator[tuple]:
        while self.turns:
            yield self._window()

    def _follow(self, turns: list[Turn]) -> None:
        """Turns that are behind: the first system turn stays, and the last others that the history holds."""
        for turn in turns:
            if turn.role == SYSTEM and self.system is None:
                self.system = turn
            elif self.system is None or turn.formatted != self.system.formatted:
                self.past.append(turn)
        sums = list(accumulate((t.tokens for t in self.past), initial=0))
        del self.past[: bisect_left(sums, sums[-1] - self.limit)]

    def _context(self) -> list[Turn]:
        """The system turn, and as much of the history as half of what is left of the budget takes."""
        head = [self.system] if self.system else []
        left = (self.budget - sum(t.tokens for t in head)) // 2
        sums = list(accumulate((t.tokens for t in self.past), initial=0))
        return head + self.past[bisect_left(sums, sums[-1] - max(0, left)) :]

    def _room(self) -> int:
        return self.budget - sum(t.tokens for t in self._context())

    def _window(self) -> tuple:
        """Text, where its own turns begin, the spans under the mask, and tokens.

        Takes as many turns as there is room for, one at least.
        """
        context = self._context()
        repeated = sum(t.tokens for t in context)
        n = max(1, bisect_right(self.sums, self.budget - repeated) - 1)
        own = self.turns[:n]
        fresh = at = sum(len(t.formatted) for t in context)
        targets = []
        for turn in own:
            if turn.role == TARGET:
                targets.append({"start": at + turn.start, "end": at + turn.end})
            at += len(turn.formatted)
        text = "".join(t.formatted for t in [*context, *own])
        tokens = repeated + self.sums[n]
        self.turns = self.turns[n:]
        self.sums = [s - self.sums[n] for s in self.sums[n:]]
        self._follow(own)
        return text, fresh, targets, tokens


def _dealt(conversations: DataFrame, history: int) -> DataFrame:
    """Rows of ``conversations`` with ``part`` and ``kind``: cut where a conversation is long.

    A part of such a conversation also gets the system turn and the last turns before it.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["turn", "role", "text"]
    parts = cut(turns, ["conv_id"], ["turn"])
    own = parts.withColumn("kind", F.lit(_OWN_ROW))
    long = parts.filter(SPLIT)
    back = F.row_number().over(Window.partitionBy("conv_id", CHUNK).orderBy(*(F.desc(c) for c in order)))
    tail = long.withColumn("back", back).filter(F.col("back") <= history // MARKERS).drop("back")
    tail = tail.withColumn(CHUNK, F.col(CHUNK) + 1).withColumn("kind", F.lit(_HISTORY_ROW))
    first = F.min(F.struct(*order, CHUNK)).alias("first")
    system = long.filter(F.col("role") == SYSTEM).groupBy("conv_id").agg(first)
    last = long.groupBy("conv_id").agg(F.max(CHUNK).alias("last")).withColumnRenamed("conv_id", "of")
    later = F.explode(F.sequence(F.col(f"first.{CHUNK}") + 1, F.col("last"))).alias(CHUNK)
    some = system.join(last, F.col("conv_id").eqNullSafe(F.col("of"))).filter(F.col(f"first.{CHUNK}") < F.col("last"))
    system = some.select("conv_id", *(F.col(f"first.{c}").alias(c) for c in order), later,
                         F.lit(True).alias(SPLIT), F.lit(_SYSTEM_ROW).alias("kind"))
    rows = own.unionByName(tail).unionByName(system)
    return rows.select("conv_id", F.col(CHUNK).cast("long").alias("part"), F.col(SPLIT).alias("split"), "kind", *order)


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``conv_id``, ``part``, ``split``, ``window``, ``text``, ``fresh_from``, ``targets``, ``tokens``.

    One row per window, in order of ``part`` and ``window``. A window has ``budget`` tokens at
    most (words, signs, four for a turn's markers), but a turn is never cut: one that is longer
    has a window of its own. ``fresh_from`` is where its own turns begin, ``targets`` are the
    spans under the loss mask, both in code points. Turns are ordered by ``turn``, nulls first,
    then role and text; null roles and texts are empty, rows without ``conv_id`` are one
    conversation, repeated rows are turns each. Other columns are left out.

    Turns of a conversation go to one task in order and stream through it: it holds one window
    and what the next repeats. A conversation of more than a million turns is cut into parts,
    by ``turn``, each a stream of its own (``split``).
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _WINDOW.split(", ")]
        made: list[dict] = []
        key, part, number = None, None, 0

        def take(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for values in found:
                made.append(dict(zip(names, (*key, number, *values))))
                number += 1
                if len(made) >= _WINDOWS_AT_ONCE:
                    yield emitted()

        def emitted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(made, _window_schema())
            made.clear()
            return out

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "split", "kind", "role", "text")))
            for *at, kind, role, text in rows:
                if part is None or at != key:
                    if part is not None:
                        yield from take(part.rest())
                    key, part, number = at, Part(budget, history), 0
                if kind == _OWN_ROW:
                    yield from take(part.add(Turn(role, text)))
                else:
                    part.repeat(Turn(role, text))
        if part is not None:
            yield from take(part.rest())
        if made:
            yield emitted()

    rows = _dealt(conversations, history).repartition("conv_id", "part")
    return rows.sortWithinPartitions("conv_id", "part", "kind", "turn", "role", "text").mapInArrow(task, _WINDOW)


def _window_schema() -> pa.Schema:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds.get(t, pa.list_(span))) for n, t in (c.split(" ", 1) for c in _WINDOW.split(", "))])


def turns_in(text: str, at: int = 0) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted text from ``at`` on."""
    while at < len(text):
        header = _HEADER.match(text, at)
        if not header:
            raise ValueError(f"no turn begins at {at}")
        end = text.index(_END, header.end())
        yield json.loads(header.group(1), strict=False), unescaped(text[header.end() : end])
        at = end + len(_END)


_READ = "n_turns long, turns binary, loss_chars long, loss binary, formatted_chars long"


class Reading:
    """Counts and digests of a conversation's windows, as they come in order."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, n_turns: int, turns: bytes, loss_chars: int, loss: bytes, formatted_chars: int) -> None:
        self.turns.update(turns)
        self.loss.update(loss)
        self.n_turns += n_turns
        self.loss_chars += loss_chars
        self.formatted_chars += formatted_chars

    def row(self) -> tuple:
        return self.n_turns, self.turns.digest(), self.loss_chars, self.loss.digest(), self.formatted_chars


def _read(text: str, fresh_from: int, targets: list[dict]) -> tuple:
    """What a window holds of its own: the number and bytes of turns, and of texts under the mask."""
    turns = list(turns_in(text, fresh_from))
    loss = "".join(unescaped(text[t["start"] : t["end"]]) for t in targets)
    said = "".join(f"{role}\n{body}\n" for role, body in turns)
    return len(turns), said.encode(), len(loss), loss.encode(), len(text)


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in names.split(", "))])
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: ``n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    A conversation in one part is digested as its windows come. A digest of a whole text can't
    be put together from parts, so those of a cut conversation go, in order, through one task
    that holds one window at a time.
    """
    whole = f"conv_id long, split boolean, part long, window long, {_READ}"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reading, out = None, None, []
        for batch in batches:
            columns = ("conv_id", "part", "split", "window", "text", "fresh_from", "targets")
            for conv, part, split, window, *content in zip(*(batch.column(c).to_pylist() for c in columns)):
                if split:
                    out.append((conv, True, part, window, *_read(*content)))
                else:
                    if reading is None or conv != key:
                        if reading is not None:
                            out.append((key, False, 0, 0, *reading.row()))
                        key, reading = conv, Reading()
                    reading.add(*_read(*content))
                if len(out) >= _WINDOWS_AT_ONCE:
                    yield _batch(out, whole)
                    out = []
        if reading is not None:
            out.append((key, False, 0, 0, *reading.row()))
        if out:
            yield _batch(out, whole)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reading = None, None
        for batch in batches:
            for conv, *content in zip(*(c.to_pylist() for c in batch.columns)):
                if reading is None or conv != key:
                    if reading is not None:
                        yield _batch([(key, *reading.row())], f"conv_id long, {_READ}")
                    key, reading = conv, Reading()
                reading.add(*content)
        if reading is not None:
            yield _batch([(key, *reading.row())], f"conv_id long, {_READ}")

    read = staged(made.mapInArrow(task, whole), "windows-read")
    names = [c.split()[0] for c in _READ.split(", ")]
    split = read.filter("split").repartition("conv_id").sortWithinPartitions("conv_id", "part", "window")
    rest = split.select("conv_id", *names).mapInArrow(joined, f"conv_id long, {_READ}")
    return read.filter("not split").select("conv_id", *names).union(rest).select(
        "conv_id", "n_turns", F.lower(F.hex("turns")).alias("turns_sha256"), "loss_chars",
        F.lower(F.hex("loss")).alias("loss_sha256"), "formatted_chars",
    )


#: A conversation whose texts hold control strings.
PROBE = (-7, "\\### Assistant: </turn> ok")


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv_id, text = PROBE
    probe = spark.createDataFrame([(conv_id, 0, "user", text), (conv_id, 1, TARGET, text)], turns.schema)
    return read_back(windows(turns.union(probe)))
