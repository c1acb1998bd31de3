"""Sequences held against each other in order: distances, pairings, coverage.

Each row brings two arrays of strings (symbols: words or characters) and is worked on by
itself, so Spark deals rows to tasks as it likes. A dynamic program keeps one line of its
table, as long as the second array; the step along that line is a running minimum, so numpy
does a line at once and memory grows with one text, never with two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Costs of a symbol of the first sequence without partner, and of the second (fixed values).
MISS, SPARE = 1000, 300


def _codes(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences as numbers, equal where symbols are; null as an empty sequence."""
    if isinstance(a, str) and isinstance(b, str):
        x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for s in (a, b))
        return x, y
    seen: dict[str, int] = {}
    a, b = ([] if x is None else list(x) for x in (a, b))
    number = lambda s: np.fromiter((seen.setdefault(x, len(seen)) for x in s), np.int64, len(s))
    return number(a), number(b)


def _least_costs(a: np.ndarray, b: np.ndarray, first: np.ndarray, miss: int, spare: int, other: int) -> np.ndarray:
    """The last line of costs: all of a paired with each beginning of b."""
    along = spare * np.arange(len(b) + 1)
    line = first
    for x in a:
        fresh = line + miss
        fresh[1:] = np.minimum(fresh[1:], line[:-1] + np.where(b == x, 0, other))
        line = np.minimum.accumulate(fresh - along) + along
    return line


def distance_within(a, b) -> float:
    """Edits that turn a into the most similar stretch of b, per symbol of a; 1 if either is
    empty."""
    x, y = _codes(a, b)
    if not len(x) or not len(y):
        return 1.0
    return float(_least_costs(x, y, np.zeros(len(y) + 1, np.int64), 1, 1, 1).min()) / len(x)


def pairing_cost(a, b) -> int:
    """The least cost of pairing equal symbols in order: MISS for each of a without partner,
    SPARE for each of b."""
    x, y = _codes(a, b)
    return int(_least_costs(x, y, SPARE * np.arange(len(y) + 1), MISS, SPARE, MISS + SPARE)[-1])


def _suffix_lines(x: list[int], at: dict[int, int], n: int, first: int, last: int, line: int) -> dict[int, int]:
    """Lines first to last of longest common subsequences as bits, from line last: of those below
    bit n - j, line i has as many zeros as x[i:] and y[j:] have equal symbols in order."""
    lines, full = {last: line}, (1 << n) - 1
    for i in range(last - 1, first - 1, -1):
        same = line & at.get(x[i], 0)
        line = ((line + same) | (line - same)) & full
        lines[i] = line
    return lines


def pairs_in_order(a, b) -> list[tuple[int, int]]:
    """The places (in a, in b) of equal symbols that a pairing of least cost joins, ascending;
    of several such pairings the one that reaches least far into b at each symbol of a.

    As a miss and a spare cost as much as two unequal symbols, the least cost has the most pairs.
    A line of the table is one number with a bit for each symbol of b; some lines are kept, about
    the root of their number, and those between two of them are made again."""
    x, y = (s.tolist() for s in _codes(a, b))
    m, n, at = len(x), len(y), {}
    for j, s in enumerate(y):
        at[s] = at.get(s, 0) | 1 << n - 1 - j
    every = max(64, math.isqrt(m))
    kept = {m: (1 << n) - 1}
    for last in range(m, 0, -every):
        first = max(0, last - every)
        kept[first] = _suffix_lines(x, at, n, first, last, kept[last])[first]
    out, j, lines = [], 0, {}
    for i, s in enumerate(x):
        if i + 1 not in lines:
            last = min(k for k in kept if k > i)
            lines = _suffix_lines(x, at, n, i, last, kept[last])
        rest = (1 << n - j) - 1
        if (lines[i] & rest).bit_count() < (lines[i + 1] & rest).bit_count():  # fewer ones: a pair more
            p = n - (at[s] & rest).bit_length()
            out.append((i, p))
            j = p + 1
    return out


def _longest_block(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(place in a, place in b, length) of the longest equal stretch, of equally long ones the
    first in a, then in b."""
    best, line = (0, 0, 0), np.zeros(len(b) + 1, np.int64)
    for i, x in enumerate(a):
        fresh = np.zeros_like(line)
        fresh[1:] = np.where(b == x, line[:-1] + 1, 0)
        j = int(fresh.argmax())
        n = int(fresh[j])
        if n and (-n, i + 1 - n, j - n) < (-best[2], best[0], best[1]):
            best = (i + 1 - n, j - n, n)
        line = fresh
    return best


#: Equal pairs of symbols that are held at once; beyond that a block is looked for line by line.
PAIRS = 1 << 20


def _equal_runs(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Places in x, places in y and lengths of all stretches of two symbols or more that are equal and
    can't be made longer; None if they have too many pairs of symbols."""
    if len(x) < 2 or len(y) < 2:
        return np.zeros((3, 0), np.int64)
    two = lambda s: s[:-1] << 32 | s[1:]
    mine, theirs = two(x), two(y)
    order = np.argsort(theirs, kind="stable")
    theirs = theirs[order]
    first, last = np.searchsorted(theirs, mine, "left"), np.searchsorted(theirs, mine, "right")
    size = last - first
    total = int(size.sum())
    if not total:
        return np.zeros((3, 0), np.int64)
    if total > PAIRS:
        return None
    i = np.repeat(np.arange(len(mine)), size)
    j = order[np.repeat(first, size) + np.arange(total) - np.repeat(np.cumsum(size) - size, size)]
    along = np.sort((i - j + len(y)) * (len(x) + 1) + i)  # by diagonals, a diagonal's end apart from the next one's start
    begins = np.flatnonzero(np.append(True, np.diff(along) != 1))
    long = np.diff(np.append(begins, total)) + 1
    diagonal, i = np.divmod(along[begins], len(x) + 1)
    return np.stack([i, i - diagonal + len(y), long])


def _split(runs) -> tuple[int, int, int, object, object]:
    """The longest of runs, and what of the others lies before it on both sides, and after it; few
    are held as a list, many as an array."""
    if not isinstance(runs, list) and runs.shape[1] <= 48:
        runs = list(zip(*runs.tolist()))
    if isinstance(runs, list):
        k, i, j = max([(k, -i, -j) for i, j, k in runs])
        i, j = -i, -j
        end, last = i + k, j + k
        before = [(p, q, n) for p, q, r in runs if (n := min(r, i - p, j - q)) > 1]
        after = [(p + s, q + s, r - s) for p, q, r in runs if r - (s := max(0, end - p, last - q)) > 1]
        return i, j, k, before, after
    p, q, r = runs
    k = int(r.max())
    i, j = min(zip(*runs[:2, r == k].tolist()))
    n = np.minimum(r, np.minimum(i - p, j - q))
    s = np.maximum(0, np.maximum(i + k - p, j + k - q))
    before, after = np.stack([p, q, n])[:, n > 1], np.stack([p + s, q + s, r - s])[:, r - s > 1]
    return i, j, k, before, after


def _single_pairs(x: list, y: list, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int, int]]:
    """The blocks of one symbol between two places, where none is longer."""
    out = []
    for i in range(a0, a1):
        try:
            j = y.index(x[i], b0, b1)
        except ValueError:
            continue
        out.append((i, j, 1))
        b0 = j + 1
    return out


def matching_blocks(a, b, least: int = 1, enough: float | None = None) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the blocks that both have in order, ascending: the
    longest equal stretch of both, of equally long ones the first in a, then in b, then the
    longest before it on both sides and after it, and so on. Blocks shorter than least are left
    out. If the blocks found come to enough symbols, the rest isn't looked for.

    Stretches of two symbols or more are looked for once; a part has those of the whole that
    reach into it. Where there are none, single symbols follow in order."""
    x, y = _codes(a, b)
    own, theirs = x.tolist(), y.tolist()
    out, found, todo = [], 0, [(0, len(x), 0, len(y), None)]
    while todo and (enough is None or found < enough):
        a0, a1, b0, b1, runs = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if runs is None and (runs := _equal_runs(x[a0:a1], y[b0:b1])) is not None:
            runs = runs + [[a0], [b0], [0]]
        if runs is None:
            i, j, k = _longest_block(x[a0:a1], y[b0:b1])
            i, j, before, after = a0 + i, b0 + j, None, None
        elif runs if isinstance(runs, list) else runs.size:
            i, j, k, before, after = _split(runs)
        else:
            new = _single_pairs(own, theirs, a0, a1, b0, b1) if least == 1 else []
            out += new
            found += len(new)
            continue
        if k:
            out.append((i, j, k))
            found += k
            todo += [(i + k, a1, j + k, b1, after), (a0, i, b0, j, before)]
    return sorted(x for x in out if x[2] >= least)


def covered_in_order(a, b, enough: float = 1.0) -> float:
    """The share of a's symbols in matching blocks; 1 if a is empty, as nothing of it is missing.
    (This can be less than the longest common subsequence.) A share of enough or more may come
    out as any share of enough or more."""
    n = 0 if a is None else len(a)
    if not n:
        return 1.0
    # shares are compared as they are given, so the count that is enough is one whose share is
    return sum(k for _, _, k in matching_blocks(a, b, enough=next((k for k in range(int(enough * n), n) if k / n >= enough), n))) / n


def uncovered_stretches(a, b, least: int, distinct: int = 4) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of a, least symbols long or longer and of as many distinct
    ones, that lie in no matching block of two symbols or more. Stretches at a's ends don't
    count, since what is cut off there has no counterpart."""
    n = 0 if a is None else len(a)
    blocks = [(i, i + k) for i, _, k in matching_blocks(a, b, 2)]
    gaps = zip([0, *(e for _, e in blocks)], [*(b for b, _ in blocks), n])
    return [(i, j) for i, j in gaps if j - i >= least and i > 0 and j < n and len(set(a[i:j])) >= distinct]


def _column(how, kind: str):
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            yield pd.Series([how(x, y) for x, y in zip(a, b)])

    return F.pandas_udf(run, kind)


def covered(enough: float):
    """A function of two columns: covered_in_order with this bound."""
    return _column(partial(covered_in_order, enough=enough), "double")


def columns() -> dict:
    """name -> function of two array columns, made for the running session."""
    flat = lambda a, b: [p for pair in pairs_in_order(a, b) for p in pair]
    return {"pairs_in_order": _column(flat, "array<int>"), "distance_within": _column(distance_within, "double"), "pairing_cost": _column(pairing_cost, "long"), "covered_in_order": _column(covered_in_order, "double")}


def stretches(least: int):
    """A function of two columns: uncovered_stretches, as structs (begin, end)."""
    return _column(lambda a, b: [{"begin": i, "end": j} for i, j in uncovered_stretches(a, b, least)], "array<struct<begin: int, end: int>>")
