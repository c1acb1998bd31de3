"""Symbols of a text placed on the frames of a recognition model's output.

Two rules for windows: ``held`` (a symbol may only hold frames of its window) and ``entered``
(a symbol may only begin in its window and then last as long as it likes). A symbol's earliest
and latest first frames follow from all windows, so at a frame only a band of symbols, and of
the blanks beside them, can be on a path: scores and back pointers are kept for the band alone,
and a song of many frames needs frames times width of the band, in bytes. Each row brings its
own frames and is worked on by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Back pointers of a place: how its symbol was reached, and whether its blank came from the
#: symbol before it.
STAYED, FROM_BLANK, FROM_SYMBOL, BLANK_ENTERED = 0, 1, 2, 4


def first_bounds(low: np.ndarray, high: np.ndarray, twin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(earliest, latest) frame in which each symbol can begin if symbol k must begin in low[k]
    to high[k], a frame after the one before it, two after an equal one (twin)."""
    steps = np.cumsum(1 + twin)
    earliest = np.maximum.accumulate(low - steps) + steps
    latest = np.minimum.accumulate((high - steps)[::-1])[::-1] + steps
    return earliest, latest


def first_frames(scores: np.ndarray, symbols, low=None, high=None, blank: int = 0, rule: str = "held") -> list[int] | None:
    """The frame in which each symbol begins on the best path; None if there is no path.

    scores has a row for each frame and a column for each symbol. On a path each frame holds a
    symbol or the blank, symbols come in order, each holds one frame or more in a row, and
    blanks may stand between them, and must between equal ones. Windows are low[k] to high[k],
    both included (all frames where these are None). Of equally good ways a path stays where it
    is rather than coming from the blank, and that rather than from the symbol before; it ends
    in the blank rather than in the last symbol. No symbols: an empty list."""
    symbols = np.asarray(symbols, np.int64)
    n, frames = len(symbols), len(scores)
    if not n or not frames:
        return [] if not n else None
    low = np.zeros(n, np.int64) if low is None else np.maximum(np.asarray(low, np.int64), 0)
    high = np.full(n, frames - 1) if high is None else np.minimum(np.asarray(high, np.int64), frames - 1)
    twin = np.append(False, symbols[1:] == symbols[:-1])
    earliest, latest = first_bounds(low, high, twin)
    if (earliest > latest).any():
        return None
    every = np.arange(frames)
    first = np.searchsorted(latest[1:], every, "right")  # symbols before it have had to give way
    last = np.searchsorted(earliest, every, "right") - 1  # symbols after it can't have begun
    own, quiet = np.full(n, -np.inf), np.full(n + 1, -np.inf)  # best sums, ending in a symbol or in the blank before it
    quiet[0] = scores[0, blank]
    if low[0] <= 0 <= high[0]:
        own[0] = scores[0, symbols[0]]
    came = []
    for f in range(1, frames):
        a, b = int(first[f]), int(last[f]) + 1  # symbols a to b - 1, blanks a to b
        before = np.append(-np.inf, own[:b]) if a == 0 else own[a - 1 : b].copy()
        back = np.where(before > quiet[a : b + 1], BLANK_ENTERED, STAYED).astype(np.uint8)
        blanks = np.maximum(quiet[a : b + 1], before) + scores[f, blank]
        if b > a:
            inside = (low[a:b] <= f) & (f <= high[a:b])
            enter = inside if rule == "entered" else True
            best = own[a:b].copy()
            for way, ok in ((FROM_BLANK, quiet[a:b]), (FROM_SYMBOL, np.where(twin[a:b], -np.inf, before[:-1]))):
                better = enter & (ok > best)
                best[better] = ok[better]
                back[:-1][better] = back[:-1][better] & BLANK_ENTERED | way
            best += scores[f, symbols[a:b]]
            own[a:b] = best if rule == "entered" else np.where(inside, best, -np.inf)
        quiet[a : b + 1] = blanks
        own[:a], quiet[:a] = -np.inf, -np.inf
        came.append(back.tobytes())
    k, sounding = (n - 1, True) if own[n - 1] > quiet[n] else (n, False)
    if max(own[n - 1], quiet[n]) == -np.inf:
        return None
    starts = [0] * n
    for f in range(frames - 1, -1, -1):
        if sounding:
            starts[k] = f
        if f:
            way = came[f - 1][k - int(first[f])]
            if sounding:
                sounding, k = way & 3 != FROM_BLANK, k - (way & 3 == FROM_SYMBOL)
            elif way & BLANK_ENTERED:
                sounding, k = True, k - 1
    return starts


def placed(width: int, blank: int = 0, rule: str = "held"):
    """A column function of (scores, symbols, low, high): ``first_frames`` of each row as an
    array of int. scores is a flat array, width values a frame, the rest of an unfinished frame
    is left out. Null scores, symbols or values in them, symbols outside 0 to width - 1 and rows
    without a path give null; null windows admit all frames."""

    def of_row(scores, symbols, low, high):
        if scores is None or symbols is None:
            return None
        flat, wanted = np.asarray(scores, np.float64), pd.array(symbols, "Int64")
        if np.isnan(flat).any() or wanted.isna().any() or ((wanted < 0) | (wanted >= width)).any():
            return None
        return first_frames(flat[: len(flat) // width * width].reshape(-1, width), wanted.to_numpy(np.int64), low, high, blank, rule)

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([of_row(*x) for x in zip(*part)], dtype=object)

    return F.pandas_udf(run, "array<int>")
