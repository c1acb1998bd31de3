"""Two sequences paired in order, within windows and at prices for distance.

A symbol of the first sequence may only be paired with the places low to high of the second;
it is due at a frame, and what is paired with it lies at one: a pair costs by their distance.
The table of costs is made line by line, within the windows. Some lines are kept, about the root
of their number or fewer, and the lines between two of them are made again when the path is
followed back, so memory is root times length and not the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Costs of a symbol without partner, of a place without partner (gentle, steep),
#: and of a pair of sounds that agree in family or vowel only.
MISS, SPARE, SPARE_STEEP, KIN = 1000, 1000, 300, 350
#: More than any path costs; a pair at this price doesn't exist.
NEVER = 1 << 50
#: Rows of a batch that are held as Python's values at once.
ROWS = 32


#: Cells of the table that are made at once, if that is more than the root of its lines.
CELLS = 1 << 16


def _paired(m: int, n: int, low, high, price: Callable[[slice, slice], np.ndarray], real: Callable[[int, int], bool], spare: int, pairs_first: bool) -> list[int]:
    """For each of m symbols its partner among n places, low to high, or -1. price gives the costs
    of stepping over symbols and places together, a line for each symbol; it is a pair if real
    says so. pairs_first: of equally good ways back the joint step, then the symbol's, then the
    place's; else the symbol's, the place's, the joint one.

    The table holds what joint steps save against stepping over both sides alone. Then a line
    stays the same before all windows that are to come, and goes on evenly behind all that have
    been, so only what lies between is worked out."""
    low, high = np.clip(np.asarray(low, np.int64), 0, n), np.clip(np.asarray(high, np.int64) + 1, 0, n)
    some = low < high
    last = np.maximum.accumulate(np.where(some, high, 0)) if m else high
    first = np.minimum(np.minimum.accumulate(np.where(some, low, n)[::-1])[::-1], last) if m else low

    def lines(i: int, stop: int, line: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        a, b = int(first[i]), int(last[stop - 1])
        own, places = price(slice(i, stop), slice(a, b)), np.arange(a, b)
        own = np.where((places >= low[i:stop, None]) & (places < high[i:stop, None]) & (own < NEVER), own - MISS - spare, NEVER)
        table = np.empty((stop - i + 1, b - a + 1), np.int64)
        table[0] = line[a : b + 1]
        table[:, 0] = table[0, 0]
        for k in range(stop - i):
            fresh = table[k + 1, 1:]
            np.add(table[k, :-1], own[k], out=fresh)
            np.minimum(fresh, table[k, 1:], out=fresh)
            np.minimum.accumulate(table[k + 1], out=table[k + 1])
        return a, table, own

    stops, kept, line = [0], [], np.zeros(n + 1, np.int64)
    while stops[-1] < m:
        i = stops[-1]
        wide = max(1, int(last[min(m, i + 64) - 1] - first[i]))
        stop = min(m, i + max(math.isqrt(m), min(64, CELLS // wide), 1))
        kept.append(line)
        a, table, _ = lines(i, stop, line)
        line = line.copy()
        line[a : a + table.shape[1]] = table[-1]
        line[a + table.shape[1] :] = table[-1, -1]
        stops.append(stop)
    out, j = [-1] * m, n
    for k in range(len(kept) - 1, -1, -1):
        top, i = stops[k], stops[k + 1]
        a, table, own = lines(top, i, kept[k])
        width = table.shape[1] - 1
        while i > top and j > max(a, 0):
            r, c = i - top, j - a
            if c > width:  # behind all windows: the symbol's step if it is as good, else the place's up to there
                if table[r, width] == table[r - 1, width]:
                    i -= 1
                else:
                    j = a + width
                continue
            here, step = table.item(r, c), own.item(r - 1, c - 1)
            joint = step < NEVER and here == table.item(r - 1, c - 1) + step
            up = here == table.item(r - 1, c)
            if joint and (pairs_first or not (up or here == table.item(r, c - 1))):
                if real(i - 1, j - 1):
                    out[i - 1] = j - 1
                i, j = i - 1, j - 1
            elif up:
                i -= 1
            else:
                j -= 1
    return out


def _distances(heard_at, due, symbols: slice, places: slice, steep: bool) -> np.ndarray:
    """What pairs of these symbols and places cost by distance; nothing for a symbol whose due is
    unknown (negative). Gentle: a fifth of it. Steep: 8 a frame beyond 25. At most 999."""
    due = np.asarray(due, np.int64)[symbols, None]
    gap = np.abs(np.asarray(heard_at, np.int64)[places] - due)
    return np.where(due < 0, 0, np.minimum(999, np.maximum(0, gap - 25) * 8 if steep else gap // 5))


def pair(lyric, heard, low, high, due, heard_at, steep: bool) -> list[int]:
    """For each symbol of lyric the place in heard of an equal one that it is paired with, or
    -1: as few as possible stay alone, and of such pairings the cheapest by distance."""
    numbers: dict = {}
    lyric, heard = (np.fromiter((numbers.setdefault(x, len(numbers)) for x in side), np.int64, len(side)) for side in (lyric, heard))
    spare = SPARE_STEEP if steep else SPARE

    def price(i: slice, j: slice) -> np.ndarray:
        return np.where(heard[j] == lyric[i, None], _distances(heard_at, due, i, j, steep), MISS + spare)

    return _paired(len(lyric), len(heard), low, high, price, lambda i, j: bool(lyric[i] == heard[j]), spare, True)


def pair_sounds(lyric, heard, low, high, due, heard_at) -> list[int]:
    """As pair, for sounds (family, vowel): equal ones pair at the price of their distance,
    those that agree in one of the two for KIN more, others not at all."""
    own, theirs = (np.array(side, np.int64).reshape(-1, 2) for side in (lyric, heard))

    def price(i: slice, j: slice) -> np.ndarray:
        family, vowel = theirs[j, 0] == own[i, :1], theirs[j, 1] == own[i, 1:]
        return np.where(family | vowel, _distances(heard_at, due, i, j, False) + np.where(family & vowel, 0, KIN), NEVER)

    return _paired(len(lyric), len(heard), low, high, price, lambda i, j: True, SPARE_STEEP, False)


def paired(mode: str):
    """A column function of (lyric, heard, low, high, due, heard_at), arrays: the partner of
    each symbol of lyric, -1 for none; mode is gentle, steep or sounds. Null low, high or due
    set no window and no time; rows with null lyric, heard or heard_at give null."""

    def of_row(lyric, heard, low, high, due, heard_at):
        if lyric is None or heard is None or heard_at is None:
            return None
        low, high, due = ([x] * len(lyric) if given is None else given for given, x in ((low, 0), (high, len(heard)), (due, -1)))
        if mode == "sounds":
            both = [[(x["family"], x["vowel"]) for x in side] for side in (lyric, heard)]
            return pair_sounds(*both, low, high, due, heard_at)
        return pair(lyric, heard, low, high, due, heard_at, mode == "steep")

    def run(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for part in parts:
            # a few rows at a time become Python's values, as a batch of them takes far more than in Arrow
            some = (zip(*[c.slice(k, ROWS).to_pylist() for c in part]) for k in range(0, len(part[0]), ROWS))
            found = [pa.array([of_row(*x) for x in rows], pa.list_(pa.int32())) for rows in some]
            yield pa.chunked_array(found, pa.list_(pa.int32())).combine_chunks()

    return F.arrow_udf(run, "array<int>")
