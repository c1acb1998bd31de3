"""Where the lines of a sheet stand in a long text, walking forward.

The text of a key comes first, then its lines in order; each is looked for from a cursor on,
which then moves behind it, so repeated lines find their own occurrences. The places of all
short stretches of the text are sorted by hash once, so a line costs a search among those that
begin like it and not a walk through the text.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.operators.folds import folded

#: Characters by which stretches are sorted: for texts of that many at least, and for shorter ones.
LONG, SHORT = 12, 2
#: How many times the length of a text plain searches may go through before stretches are sorted.
WALKS = 8
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Occurrences:
    """Finds texts of SHORT characters or more in one text. Lines mostly stand at the cursor or
    near it: plain search goes through WALKS times the text in all, then stretches are sorted."""

    def __init__(self, text: str):
        self.text, self.left = text, WALKS * len(text)
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _hashes(text: str, size: int) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = max(0, len(points) - size + 1)
        found = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size):
                found = (found + points[j : j + n] + np.uint64(1)) * _FACTOR
        return found

    def _starts(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        found = self._hashes(self.text, size)
        order = np.argsort(found, kind="stable")
        return found[order], order

    def find(self, text: str, since: int = 0) -> int:
        """The first place from since on, -1 if there is none."""
        if self.left > 0:
            at = self.text.find(text, since)
            self.left -= (len(self.text) if at < 0 else at + len(text)) - since
            return at
        size = LONG if len(text) >= LONG else SHORT
        if size not in self._sorted:
            self._sorted[size] = self._starts(size)
        (own,) = self._hashes(text[:size], size)
        hashes, places = self._sorted[size]
        run = places[np.searchsorted(hashes, own, "left") : np.searchsorted(hashes, own, "right")]
        for at in run[np.searchsorted(run, since) :].tolist():
            if self.text.startswith(text, at):
                return at
        return -1


class _Lines:
    """The pieces of a key's text, whose readings are given with them, and a cursor."""

    def __init__(self):
        self.index, self.cursor = None, 0

    def take(self, row: tuple) -> list[tuple]:
        side, place, text, pieces = row
        if not side:
            self.readings = [x["reading"] for x in pieces or []]
            bases = [x["base"] for x in pieces or []]
            self.starts = np.cumsum([0, *map(len, bases)]).tolist()
            self.index = Occurrences("".join(bases))
            return []
        if self.index is None or text is None or len(text) < SHORT:
            return []
        at = self.index.find(text, self.cursor)
        at = self.index.find(text) if at < 0 else at
        if at < 0:
            return []
        self.cursor = at + len(text)
        a, b = bisect.bisect_left(self.starts, at), bisect.bisect_left(self.starts, self.cursor)
        whole = self.starts[a] == at and self.starts[b] == self.cursor
        # pieces without a character have no place of their own: they go with none
        inside = [r for r, x, y in zip(self.readings[a:b], self.starts[a:], self.starts[a + 1 :]) if x < y]
        return [(place, at, "".join(inside) if whole else None)]

    def end(self) -> list[tuple]:
        return []


def located(pages: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, place, at, reading) of the lines (by, place, text) that stand in their key's page
    (by, pieces), an array of (base, reading) whose bases make the page's text.

    A line is looked for from the cursor on, else from the start; found, it moves the cursor
    behind it. reading puts the readings of its pieces together, null if it cuts a piece. Lines
    of less than SHORT characters, null ones and those without page are left out. One page, and
    one line at a time, is held."""
    page = pages.select(*by, F.lit(0).alias("side"), F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("text"), "pieces")
    asked = lines.select(*by, F.lit(1).alias("side"), F.col("place").cast("long").alias("place"), "text", F.lit(None).cast(page.schema["pieces"].dataType).alias("pieces"))
    return folded(page.unionByName(asked), by, ["side", "place"], _Lines, "place long, at long, reading string")


class _Forward:
    """Where each text stands among a key's old rows, and the place behind the last match."""

    def __init__(self):
        self.places, self.starts, self.cursor = {}, [], 0

    def take(self, row: tuple) -> list[tuple]:
        side, place, start, text, distinct = row
        if not side:
            self.places.setdefault(text, []).append(len(self.starts))
            self.starts.append(start)
            return []
        own = self.places.get(text, [])
        i = bisect.bisect_left(own, self.cursor)
        if i == len(own):
            return []
        self.cursor = own[i] + 1
        return [(place, start, self.starts[own[i]])]

    def end(self) -> list[tuple]:
        return []


def matched_forward(lines: DataFrame, old: DataFrame, by: list[str]) -> DataFrame:
    """(by, place, start, old_start) of lines (by, place, start, text) that correspond to rows
    of old, which has the same columns.

    If old has as many different starts as there are lines in the key, lines and starts, in
    order of first appearance, correspond by position. Else a line takes the first old row of
    the same text behind the one that was taken last. A key's old texts are held."""
    firsts = old.groupBy(*by, "start").agg(F.min("place").alias("first"))
    sizes = lines.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(firsts.groupBy(*by).agg(F.count(F.lit(1)).alias("m")), by).where("n = m").select(*by)
    by_place = _numbered(lines, by, "place").join(sizes, by).drop("text")
    positions = by_place.join(_numbered(firsts, by, "first").select(*by, "number", F.col("start").alias("old_start")), [*by, "number"])
    rest = [x.join(sizes, by, "left_anti").select(*by, F.lit(k).alias("side"), F.col("place").cast("long").alias("place"), F.col("start").cast("double").alias("start"), "text", F.lit(0).alias("distinct")) for k, x in ((1, lines), (0, old))]
    texts = folded(rest[0].unionByName(rest[1]), by, ["side", "place"], _Forward, "place long, start double, old_start double")
    return positions.select(*by, F.col("place").cast("long").alias("place"), F.col("start").cast("double").alias("start"), F.col("old_start").cast("double").alias("old_start")).unionByName(texts)


def _numbered(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    from pyspark.sql import Window

    number: Column = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("number", number)
