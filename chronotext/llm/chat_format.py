"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. Nothing is assumed of it:
successive prefixes of a conversation are rendered, and what an output adds to the one before
is the turn's span. An output that doesn't begin with the one before rewrites history; its
turns are marked. A text's place within its span comes from rendering the same prefix with a
probe character for the text.

Every prefix is rendered whole, so work grows with the square of a conversation's length and
its turns so far are in memory. A template whose rendering of a turn depends on that turn
alone may say so by an attribute ``stateless = True``, as ``marked_turns`` does; its prefixes
are rendered within a window of the latest turns: after WINDOW turns the prefix starts anew
with the last CONTEXT ones. Turns are dealt by conversation once and stream through a task in
order. A digest over a conversation is sequential by its nature, so one task streams even a
very long one; for a stateless template nothing but the current window is in its memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

Template = Callable[[list[tuple[str, str]]], str]
WINDOW, CONTEXT = 8, 2
PROBE = "\ue000"
#: The template's control strings.
BEGIN, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """text without control strings; ``unescape`` gives it back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def marked_turns(turns: list[tuple[str, str]]) -> str:
    """The template in use: each turn between control strings, its role on the first line."""
    return "".join(BEGIN + escape(role).replace("\n", "\\n") + "\n" + escape(text) + END + "\n" for role, text in turns)


marked_turns.stateless = True


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns that marked_turns wrote."""
    found, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return found


class Renderer:
    """Spans of one conversation's turns, one after another."""

    def __init__(self, template: Template):
        self.template, self.turns = template, []
        self.before = template([])
        self.stateless = getattr(template, "stateless", False)

    def add(self, role: str, text: str) -> tuple[str, int, int, bool]:
        """(span, start and stop of the text in it, whether history was rewritten). Where it
        was, the span begins at the first difference and has no place for the text."""
        if self.stateless and len(self.turns) >= WINDOW:
            self.turns = self.turns[-CONTEXT:]
            self.before = self.template(self.turns)
        probed = self.template([*self.turns, (role, PROBE)])
        self.turns.append((role, text))
        now, before = self.template(self.turns), self.before
        self.before = now
        if not now.startswith(before):
            same = next((i for i, (a, b) in enumerate(zip(before, now)) if a != b), min(len(before), len(now)))
            return now[same:], 0, 0, True
        span, head = now[len(before) :], probed.find(PROBE, len(before))
        if head < 0 or not probed.startswith(before):
            return span, 0, 0, False
        start = head - len(before)
        stop = len(span) - (len(probed) - head - len(PROBE))
        alike = stop >= start and span[:start] == probed[len(before) : head] and span[stop:] == probed[head + len(PROBE) :]
        return (span, start, stop, False) if alike else (span, 0, 0, False)


SPANS = (("turn", "bigint"), ("place", "bigint"), ("start", "bigint"), ("stop", "bigint"), ("loss_start", "bigint"), ("loss_stop", "bigint"), ("rewrites", "boolean"), ("span", "string"))


def format_turns(turns: DataFrame, template: Template = marked_turns, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """A row for each row of turns: conv_col, turn, place (0, 1, ... in its conversation),
    start and stop (code points of the formatted conversation), loss_start and loss_stop (its
    text there if its role is ``trained``, else both equal start), rewrites, span.

    A conversation is formatted as its spans in order, after what the template makes of no
    turns, which belongs to the first span. Rows of a conversation are ordered by turn (null
    first), then role, then text; equal rows are turns of their own. Null roles and texts are
    empty ones; rows without conversation id form one conversation. A partition of the result
    holds whole conversations in order. An empty table gives no rows."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text")))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role, text)
    kind = StructType([rows.schema["conv"]])
    for name, t in SPANS:
        kind = kind.add(name, common.spark_type(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = run
        renderer, at, place, out = None, 0, 0, []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out))
            kinds = [conv_type, *[pa.int64()] * 6, pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv", *[n for n, _ in SPANS]])

        for b in batches:
            conv_type = b.column("conv").type
            for conv, turn, role, text in zip(*[b.column(c).to_pylist() for c in ("conv", "turn", "role", "text")]):
                if current is run or conv != current:
                    current, renderer, at, place = conv, Renderer(template), 0, 0
                    prologue = renderer.before
                else:
                    prologue = ""
                span, a, z, rewrites = renderer.add(role, text)
                a, z = (a + len(prologue), z + len(prologue)) if role == trained and z > a else (0, 0)
                span = prologue + span
                out.append((conv, turn, place, at, at + len(span), at + a, at + z, rewrites, span))
                at, place, held = at + len(span), place + 1, held + len(span)
                if held > 1 << 20:
                    yield batch()
                    out, held = [], 0
        if out:
            yield batch()

    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.mapInArrow(run, kind).withColumnRenamed("conv", conv_col)


def read_back(formatted: DataFrame, conv_col: str = "conv_id", read: Callable[[str], list[tuple[str, str]]] = read_turns, unmask: Callable[[str], str] = unescape) -> DataFrame:
    """A row for each conversation of format_turns' result, from its spans alone: conv_col,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites (number of
    turns). Digests are made as spans stream by, so the rows must come as format_turns gives
    them; rows that were dealt anew or sorted otherwise are refused with a ValueError."""
    rows = formatted.select(F.col(conv_col).alias("conv"), "start", "loss_start", "loss_stop", "rewrites", "span")
    kind = StructType([rows.schema["conv"]])
    names = (("n_turns", "bigint"), ("turns_sha256", "string"), ("loss_chars", "bigint"), ("loss_sha256", "string"), ("formatted_chars", "bigint"), ("rewrites", "bigint"))
    for name, t in names:
        kind = kind.add(name, common.spark_type(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = run
        conv_type, done = pa.null(), []
        turns = loss = None
        n = loss_n = chars = rewritten = reached = 0

        def row():
            return current, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars, rewritten

        def batch() -> pa.RecordBatch:
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], ["conv", *[x for x, _ in names]])

        for b in batches:
            conv_type = b.column("conv").type
            for conv, start, a, z, rewrites, span in zip(*[c.to_pylist() for c in b.columns]):
                fresh = current is run or conv != current
                if start != 0 if fresh else start < reached and not rewrites:
                    raise ValueError(f"the turns of conversation {conv} are not in order")
                reached = start
                if fresh:
                    if current is not run:
                        done.append(row())
                    current, n, loss_n, chars, rewritten = conv, 0, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, text in read(span):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                masked = unmask(span[a - start : z - start])
                loss.update(masked.encode("utf-8", "surrogatepass"))
                loss_n, chars, rewritten = loss_n + len(masked), chars + len(span), rewritten + rewrites
            if len(done) >= 1000:
                yield batch()
                done = []
        if current is not run:
            done.append(row())
        if done:
            yield batch()

    return rows.mapInArrow(run, kind).withColumnRenamed("conv", conv_col)
