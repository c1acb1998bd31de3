"""Folds over the rows of a key in order: what stays depends on what stayed before.

``folded`` deals keys to tasks and streams each task's rows, sorted, through a state that holds
what one row hands on to the next; a key of any length needs no more. Where an order-dependent
rule is a running maximum in other words, it is one here, and stays in Spark.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from chronotext.functions import sounds

#: Rows that a task gives on at once.
BATCH = 8192


def folded(rows: DataFrame, by: list[str], order: list[str | Column], start: Callable[[], object], kind: str) -> DataFrame:
    """(by, and the columns of the DDL kind) from a fold over the rows of each key in order.

    start makes a key's state: its take(row) gives tuples of kind for a row, a tuple of the
    columns beside by, and its end() those that come when the key is over. Null keys are a key.
    Rows of equal order come in any order, so order should tell them apart."""
    own = [c for c in rows.columns if c not in by]
    schema = StructType([rows.schema[c] for c in by] + list(StructType.fromDDL(kind)))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in by]) if by else iter(lambda: (), None)
            for k, row in zip(keys, zip(*[batch.column(c).to_pylist() for c in own])):
                if state is None or k != key:
                    out += [(*key, *x) for x in state.end()] if state else []
                    key, state = k, start()
                out += [(*k, *x) for x in state.take(row)]
                if len(out) >= BATCH:
                    yield flush()
        out += [(*key, *x) for x in state.end()] if state else []
        while out:
            rest, out[:] = out[BATCH:], out[:BATCH]
            yield flush()
            out += rest

    dealt = rows.repartition(*by) if by else rows.coalesce(1)
    return dealt.sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def _heard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (.., at, joined) whose sound is a sound of its own: those that aren't joined to the
    row before, and of a chain of joined ones each that comes too late after the last that stayed."""
    stayed = 0
    for batch in batches:
        at, joined = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "joined"))
        keep = ~joined
        # where each chain begins; one that goes on from the last batch, with what stayed there
        begin = np.maximum.accumulate(np.where(keep, np.arange(len(at)), -1))
        since = np.where(begin < 0, stayed, at[begin])
        late = np.flatnonzero(joined & (at - since > sounds.ONE_SOUND))
        chain, last = None, 0
        for i in late.tolist():
            if chain != begin[i]:
                chain, last = begin[i], since[i]
            if at[i] - last > sounds.ONE_SOUND:
                keep[i], last = True, at[i]
        if len(at):
            stayed = int(at[np.flatnonzero(keep)[-1]]) if keep.any() else stayed
        yield batch.filter(pa.array(keep)).drop_columns(["joined"])


def family_stream(letters: DataFrame, by: list[str], pinyin: bool = False) -> DataFrame:
    """(by, place, at, family) of a reading (by, place, at, letter): letters that are no sound
    go, and a family heard again at most ONE_SOUND frames after the one that stayed last goes."""
    w = Window.partitionBy(*by).orderBy("place")
    before = F.when(F.col("at") - F.lag("at").over(w) <= sounds.ONE_WORD, F.lag("letter").over(w)).otherwise("")
    heard = letters.withColumn("family", sounds.letter_family(F.col("letter"), before, pinyin)).where("family > 0")
    rows = heard.select(*by, F.col("place").cast("long"), F.col("at").cast("long"), F.col("family").cast("int"))
    # a row after more than ONE_SOUND stays whatever stayed before it
    joined = (F.lag("family").over(w) == F.col("family")) & (F.col("at") - F.lag("at").over(w) <= sounds.ONE_SOUND)
    chains = rows.withColumn("joined", F.coalesce(joined, F.lit(False)))
    return chains.sortWithinPartitions(*by, "place").mapInArrow(_heard, rows.schema)


def with_room(pins: DataFrame, by: list[str]) -> DataFrame:
    """pins (by, place, frame, same, hand) with ``kept``: whether a pin leaves room for what
    stands between it and the kept one before.

    place numbers the symbols, same says that a symbol equals the one before it (a column of
    the number of such symbols up to and including this one), and a symbol needs a frame, an
    equal one two. Pins set by hand stay, and are what later ones are held against. A pin's
    slack is its frame less the room that all symbols up to it need; a pin stays if its slack is
    no less than that of the last that stayed, which is the greatest since the last hand's."""
    slack = F.col("frame") - F.col("place") - F.col("same")
    w = Window.partitionBy(*by).orderBy("place")
    cut = pins.select("*", slack.alias("__slack"), F.sum(F.col("hand").cast("int")).over(w).alias("__since"))
    before = F.max("__slack").over(Window.partitionBy(*by, "__since").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn("kept", F.col("hand") | before.isNull() | (F.col("__slack") >= before)).drop("__slack", "__since")


def pushed_back(units: DataFrame, by: list[str], shown: int, least: int) -> DataFrame:
    """units (by, unit, start, stop), stop being when the next group begins, with ``pushed``:
    starts moved so that the last unit has shown before stop if the ones before can spare it.

    The last unit starts at stop - shown at the latest, but leaves least for each unit after the
    first. A unit before it, the first aside, moves to least before its successor unless it is
    as far as that already; the units before such a one stay. A group's last unit that has room
    enough, or is its only one, moves nothing."""
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("unit")
    size, place = F.count(F.lit(1)).over(group), F.row_number().over(order)
    begin, final = (f("start").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for f in (F.first, F.last))
    known = units.select("*", place.alias("__place"), size.alias("__size"), begin.alias("__begin"), final.alias("__final"))
    tight = (F.col("__size") > 1) & (F.col("stop") - F.col("__final") < shown)
    newest = F.greatest(F.col("__begin") + least * (F.col("__size") - 1), F.least(F.col("__final"), F.col("stop") - shown))
    known = known.withColumn("__last", F.when(tight, newest).otherwise(F.col("__final")))
    after = F.col("__last") - least * (F.col("__size") - F.col("__place"))
    settled = F.max(F.when((F.col("__place") < F.col("__size")) & (F.col("start") <= after), F.col("__place"))).over(group)
    moves = tight & (F.col("__place") > 1) & (F.col("__place") > F.coalesce(settled, F.lit(1))) & (F.col("__place") < F.col("__size"))
    pushed = F.when(F.col("__place") == F.col("__size"), F.col("__last")).when(moves, after).otherwise(F.col("start"))
    return known.withColumn("pushed", pushed).drop("__place", "__size", "__begin", "__final", "__last")


#: Readings this many frames apart disagree.
CLASH = 10


def _middle(votes: list[int]) -> int:
    own = sorted(votes)
    half = len(own) // 2
    return own[half] if len(own) % 2 else int((own[half - 1] + own[half]) / 2)


class _Votes:
    """Anchors as the readings leave them; holds the last pin of a unit before the row's."""

    def __init__(self):
        self.unit, self.cleared = None, False
        self.own = self.before = None  # (place, frame): last pin in this unit, and before it

    def fits(self, place: int, frame: int, after_place, after_frame) -> bool:
        """Two frames for each symbol between a pin and its pinned neighbours."""
        behind = self.before is None or frame - self.before[1] >= 2 * (place - self.before[0])
        return behind and (after_place is None or after_frame - frame >= 2 * (after_place - place))

    def take(self, row: tuple) -> list[tuple]:
        place, unit, leading, anchor, votes, second, after_place, after_frame = row
        if unit != self.unit:
            self.before = self.own or self.before
            self.unit, self.cleared, self.own = unit, False, None
        anchor, said, loose, strong = None if self.cleared else anchor, "none", False, False
        votes, second = list(votes or []), list(second or [])
        if leading and votes:
            agreed = _middle(second) if len(second) >= 2 and max(second) - min(second) <= CLASH else None
            middle = _middle(votes)
            close = max(votes) - min(votes) <= CLASH
            if anchor is not None:
                far = [v for v in votes if abs(v - anchor) > CLASH]
                if agreed is not None and abs(agreed - anchor) > CLASH:
                    anchor, said, loose, strong, self.cleared = agreed, "overruled", True, True, True
                elif len(far) < len(votes):
                    said = "kept"
                elif len(far) >= 2 and close and self.fits(place, middle, after_place, after_frame):
                    anchor, said, loose, self.cleared = middle, "overruled", True, True
                else:
                    anchor, said, self.cleared = None, "cancelled", True
            elif agreed is not None:
                anchor, said, loose, strong = agreed, "added", True, True
            elif (len(votes) == 1 or close) and self.fits(place, middle, after_place, after_frame):
                anchor, said, loose = middle, "added", True
        if anchor is not None:
            self.own = (place, anchor)
        return [(place, unit, anchor, said, loose, strong)]

    def end(self) -> list[tuple]:
        return []


def voted(symbols: DataFrame, by: list[str]) -> DataFrame:
    """(by, place, unit, anchor, said, loose, strong) of symbols (by, place, unit, leading,
    anchor, votes, second), by the votes of other readings on each unit's leading symbol, which
    is its first.

    votes are the frames at which other readings heard it, second those of the second model.
    Two of the second model's that agree are strong: they are added, or overrule an anchor more
    than CLASH away. Otherwise an anchor that any vote is near stays (kept); one that all votes
    are far from is replaced if two or more of them agree and their middle fits, else it goes
    (cancelled); votes that agree add an anchor that fits. An anchor fits if there are two
    frames for each symbol between it and the pins beside it in other units, of which those
    before are already voted on. At last pins that leave less than a frame a symbol to the
    strong ones beside them go (dropped). Rows without place or unit must not be there."""
    # range frames count along the order, so the units after this one are those of smaller -unit
    after = F.min(F.when(F.col("anchor").isNotNull(), F.struct("place", "anchor"))).over(Window.partitionBy(*by).orderBy(-F.col("unit")).rangeBetween(Window.unboundedPreceding, -1))
    rows = symbols.withColumn("__after", after).select(*by, "place", "unit", "leading", "anchor", "votes", "second", F.col("__after.place").alias("after_place"), F.col("__after.anchor").alias("after_frame"))
    kind = "place long, unit long, anchor long, said string, loose boolean, strong boolean"
    got = folded(rows, by, ["place"], _Votes, kind)
    pin = F.when(F.col("strong"), F.struct("place", "anchor"))
    w = Window.partitionBy(*by).orderBy("place")
    left = F.last(pin, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.last(pin, ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, -1))
    near = got.withColumns({"__left": left, "__right": right})
    crowded = (F.col("anchor") - F.col("__left.anchor") < F.col("place") - F.col("__left.place"), F.col("__right.anchor") - F.col("anchor") < F.col("__right.place") - F.col("place"))
    weak = F.col("anchor").isNotNull() & ~F.col("strong") & (F.coalesce(crowded[0], F.lit(False)) | F.coalesce(crowded[1], F.lit(False)))
    return near.withColumns({"said": F.when(weak, "dropped").otherwise(F.col("said")), "loose": F.col("loose") & ~weak, "anchor": F.when(~weak, F.col("anchor"))}).drop("__left", "__right")


class _Jams:
    """Windows of a key's symbols, from which pins go until every symbol can begin in its own.

    Holds numbers of the key's symbols, 41 bytes each: a pin far behind or ahead may have to go
    for a jam, so they are kept until the key is over."""

    def __init__(self):
        self.low, self.high, self.pin, self.slack = (array("q") for _ in range(4))
        self.need, self.hand, self.place = array("b"), array("b"), array("q")

    def take(self, row: tuple) -> list[tuple]:
        place, low, high, pin, slack, same, hand = row
        for own, x in ((self.place, place), (self.low, low), (self.high, high), (self.pin, -1 if pin is None else pin), (self.slack, slack or 0), (self.need, 2 if same else 1), (self.hand, bool(hand))):
            own.append(x)
        return []

    def end(self) -> list[tuple]:
        n = len(self.place)
        low, high, pin, slack, need = (np.frombuffer(x, np.int8 if x.typecode == "b" else np.int64) for x in (self.low, self.high, self.pin, self.slack, self.need))
        pin, hand, room = pin.copy(), np.frombuffer(self.hand, np.int8) > 0, np.cumsum(need)
        free = np.flatnonzero((pin >= 0) & ~hand).tolist()
        gone, ok = np.zeros(n, bool), True
        a = 0  # windows and earliest frames before it stand
        enter_low, enter_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        earliest = np.zeros(n, np.int64)
        size = 1 << 12
        while a < n:
            b = min(n, a + size)
            while b < n and pin[b - 1] < 0:  # a stretch ends at a pin, which bounds what is before it
                b += 1
            self._windows(a, b, pin, low, high, slack, hand, enter_low, enter_high)
            shifted = np.maximum.accumulate(np.append(earliest[a - 1] - room[a - 1] if a else -1, enter_low[a:b] - room[a:b]))[1:]
            earliest[a:b] = shifted + room[a:b]
            jams = np.flatnonzero(earliest[a:b] >= enter_high[a:b])
            if not len(jams):
                a = n if b == n else b - 1  # the next stretch begins at this one's last pin
                continue
            jam = a + int(jams[0])
            at = int(np.searchsorted(free, jam)) if free else 0
            near = [k for k in (at - 1, at) if 0 <= k < len(free)]
            if not near:
                ok = False
                break
            k = free.pop(min(near, key=lambda x: abs(free[x] - jam)))
            pin[k], gone[k] = -1, True
            before = np.flatnonzero(pin[max(0, k - size) : k] >= 0)
            a = min(a, max(0, k - size) + int(before[-1]) if len(before) else self._pin_before(pin, k))
        if not ok:
            self._windows(0, n, pin, low, high, slack, hand, enter_low, enter_high)
        return [(int(p), int(x), int(y), bool(g), ok) for p, x, y, g in zip(self.place, enter_low, enter_high, gone)]

    @staticmethod
    def _pin_before(pin: np.ndarray, k: int) -> int:
        before = np.flatnonzero(pin[:k] >= 0)
        return int(before[-1]) if len(before) else 0

    @staticmethod
    def _windows(a: int, b: int, pin, low, high, slack, hand, enter_low, enter_high) -> None:
        """Windows of symbols a to b - 1; a and b - 1 are pinned or at the ends."""
        own, none = pin[a:b], 1 << 60
        pinned = own >= 0
        floor = np.maximum.accumulate(np.where(pinned, np.arange(b - a), -1))
        floor = np.where(floor >= 0, own[floor], 0)
        ahead = np.minimum.accumulate(np.where(pinned, np.arange(b - a), none)[::-1])[::-1]
        ceiling = np.where(ahead < none, own[np.minimum(ahead, b - a - 1)] + 1, none)
        reach = np.where(hand[a:b], 0, slack[a:b])
        lows = np.where(pinned, own - reach, np.maximum(low[a:b], floor))
        enter_low[a:b] = lows
        enter_high[a:b] = np.where(pinned, own + reach + 1, np.maximum(np.minimum(high[a:b], ceiling + 1), lows + 1))


def unjammed(symbols: DataFrame, by: list[str]) -> DataFrame:
    """(by, place, low, high, gone, ok) of symbols (by, place, low, high, pin, slack, same,
    hand): windows, low included and high not, in which symbols begin.

    A pinned symbol begins within slack of its pin, one pinned by hand at it; any other one in
    its own window, not before the last pin before it nor after the next one. A symbol begins a
    frame after the one before it, two after an equal one. Where that leaves a symbol no frame,
    the pin nearest to it in places, of two the earlier, goes (gone), hands aside, and all is
    looked at anew. ok is false for keys in which no pins but hands are left and it still jams."""
    kind = "place long, low long, high long, gone boolean, ok boolean"
    rows = symbols.select(*by, *[F.col(c).cast("long") for c in ("place", "low", "high", "pin", "slack")], "same", "hand")
    return folded(rows, by, ["place"], _Jams, kind)
