"""When lines that stand in slots of a picture begin to be wiped, from streams and batches.

A frame of a slot is two sets of cells: those that look like text, and those that are bright. A
line is there when text cells have been the same for STILL frames; it begins when its bright
cells go at its left end. One step from frame to frame serves both a stream, whose state Spark
keeps by slot, and a batch, whose rows stream by in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chronotext.operators.folds import folded

#: Frames that a line stands still, the share of bright cells below which a wipe
#: may have begun, that of its left end, that below which it is over, the share of new cells
#: that makes another line, and the left end as a part of the line's columns.
STILL, BEGUN, LEFT_BEGUN, OVER, OTHER, LEFT_PART = 3, 0.95, 0.8, 0.15, 0.4, 5


@dataclass
class Rule:
    """least cells of text make a line, more than other new ones at least another line; cells
    are numbered row by row, width to a row, and the left end has left columns at least."""

    least: int = 350
    other: int = 200
    width: int = 640
    left: int = 8


@dataclass
class Slot:
    rule: Rule
    recent: list[list[int]] = field(default_factory=list)
    line: list[int] | None = None
    size: int = 0
    begun: bool = False

    def frame(self, text: list[int], bright: list[int]) -> int | None:
        """Goes on by a frame; the size of the line that begins to be wiped in it, if one does."""
        shown, found = set(bright), None
        self.recent = [*self.recent, sorted(set(text))][-STILL:]
        share = lambda cells: sum(c in shown for c in cells) / len(cells)
        if self.line is not None:
            still = share(self.line)
            if not self.begun and still < BEGUN:
                columns = [c % self.rule.width for c in self.line]
                edge = min(columns) + max(self.rule.left, (max(columns) - min(columns)) // LEFT_PART)
                if share([c for c, x in zip(self.line, columns) if x < edge]) < LEFT_BEGUN:
                    found, self.begun = self.size, True
            if still < OVER:
                self.line = None
        stable = set(self.recent[0]).intersection(*self.recent[1:]) if len(self.recent) == STILL else set()
        if len(stable) > self.rule.least and (self.line is None or len(stable.difference(self.line)) > max(self.rule.other, self.size * OTHER)):
            self.line, self.size, self.begun = sorted(stable), len(stable), False
        return found

    def written(self) -> str:
        return json.dumps([self.recent, self.line, self.size, self.begun])


@dataclass
class _Start:
    rule: Rule

    def __call__(self) -> _Fold:
        return _Fold(Slot(self.rule))


@dataclass
class _Fold:
    slot: Slot

    def take(self, row: tuple) -> list[tuple]:
        index, text, bright = row
        size = self.slot.frame(text or [], bright or [])
        return [] if size is None else [(index, size)]

    def end(self) -> list[tuple]:
        return []


class _Processor(StatefulProcessor):
    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("slot", "written string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slot = Slot(self.rule, *json.loads(self.state.get()[0])) if self.state.exists() else Slot(self.rule)
        frames = pd.concat(list(rows)).sort_values("index")
        cells = lambda x: [] if x is None else [int(c) for c in x]
        found = [(key[0], i, slot.frame(cells(t), cells(b))) for i, t, b in zip(frames["index"], frames["text"], frames["bright"])]
        self.state.update((slot.written(),))
        yield pd.DataFrame([x for x in found if x[2] is not None], columns=["slot", "index", "size"])

    def close(self) -> None:
        pass


def wipes(frames: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """(slot, index, size) of the lines that begin to be wiped, of frames (slot, index, text,
    bright); null sets are empty.

    On a stream each slot's frames must come in order of index, within a micro-batch in any;
    state is a line and STILL frames for each slot, in the RocksDB state store, so a restart
    goes on from its checkpoint."""
    rows = frames.select("slot", "index", "text", "bright")
    kind = rows.schema["slot"].dataType.simpleString()
    if frames.isStreaming:
        return rows.groupBy("slot").transformWithStateInPandas(_Processor(rule), f"slot {kind}, index long, size int", "append", "none")
    return folded(rows, ["slot"], ["index"], _Start(rule), "index long, size int")
