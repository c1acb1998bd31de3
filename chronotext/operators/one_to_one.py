"""Greedy one-to-one matching by nearness in time, and the first match in a band."""

from __future__ import annotations

import bisect
from collections import deque
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotext.operators import sequences
from chronotext.operators.folds import folded


def first_in_band(left: DataFrame, right: DataFrame, by: list[str], tolerance: int) -> DataFrame:
    """left (by, id, t) with match_id and match_t of the earliest right row within tolerance,
    at one time the one with the smallest id; null if there is none.

    Left rows are moved to the start of their band and sorted among right rows; the match is
    the next right row, so nothing is joined."""
    own = F.when(F.col("side") == 1, F.struct("t", "id"))
    moved = left.select(*by, "id", (F.col("t") - tolerance).alias("t"), F.lit(0).alias("side"))
    both = moved.unionByName(right.select(*by, "id", "t", F.lit(1).alias("side")))
    order = sequences.backwards(by, ["t", "side", "id"]).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("m", F.last(own, ignorenulls=True).over(order)).where("side = 0").withColumn("t", F.col("t") + tolerance)
    near = F.col("m.t") <= F.col("t") + tolerance
    return found.select(*by, "id", "t", F.when(near, F.col("m.id")).alias("match_id"), F.when(near, F.col("m.t")).alias("match_t"))


def greedy_pairs(left: list[tuple[int, int]], right: list[tuple[int, int]], tolerance: int) -> list[tuple[int, int, int]]:
    """(left id, right id, gap): rows (t, id) of left, in order, each take the nearest right
    row within tolerance that is still free, of equally near ones the earlier."""
    free, out = sorted(right), []
    for t, own in sorted(left):
        at = bisect.bisect_left(free, (t,))
        # before t the nearest has the greatest t and, at that t, the smallest id
        below = bisect.bisect_left(free, (free[at - 1][0],)) if at else None
        options = [(abs(free[i][0] - t), free[i][0], i) for i in (below, at) if i is not None and i < len(free)]
        if options and (best := min(options))[0] <= tolerance:
            out.append((own, free.pop(best[2])[1], best[0]))
    return out


class _Greedy:
    """Left rows that wait for the rows after them, and free right rows they may still reach."""

    def __init__(self, tolerance: int):
        self.tolerance, self.waiting, self.free = tolerance, deque(), []

    def _match(self) -> list[tuple]:
        t, own = self.waiting.popleft()
        del self.free[: bisect.bisect_left(self.free, (t - self.tolerance,))]  # no later row reaches them
        found = greedy_pairs([(t, own)], self.free, self.tolerance)
        for _, match, _ in found:
            self.free.remove(next(x for x in self.free if x[1] == match))
        return found

    def take(self, row: tuple) -> list[tuple]:
        t, side, own = row
        out = []
        while self.waiting and t > self.waiting[0][0] + self.tolerance:
            out += self._match()
        (self.free if side else self.waiting).append((t, own))
        return out

    def end(self) -> list[tuple]:
        return [x for _ in range(len(self.waiting)) for x in self._match()]


def greedy_nearest(left: DataFrame, right: DataFrame, by: list[str], tolerance: int) -> DataFrame:
    """(by, left_id, right_id, gap) of a greedy one-to-one matching in order of left's time.

    A key's rows stream by in order of time; a left row is matched when those it can reach have
    come, so a task holds the rows within twice the tolerance, however long the key is. Ids of
    right rows tell them apart. Keys without left or right rows give nothing."""
    both = left.select(*by, "t", F.lit(0).alias("side"), "id").unionByName(right.select(*by, "t", F.lit(1).alias("side"), "id"))
    return folded(both, by, ["t", "side", "id"], partial(_Greedy, tolerance), "left_id long, right_id long, gap long")
