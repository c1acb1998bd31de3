"""Offsets of recordings and stretches that were heard but aren't written, against plain versions."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.operators import alignment, listening, signals


def direct(a, b):
    z = lambda x: np.zeros(len(x)) if np.std(x) == 0 else (x - np.mean(x)) / np.std(x)
    full = np.correlate(z(np.array(a)), z(np.array(b)), "full") / min(len(a), len(b))
    return {k - len(b) + 1: round(float(s), 6) for k, s in enumerate(full)}


@pytest.mark.parametrize("size", [4, 16, 4096])
def test_correlations(spark, size):
    dice, own = random.Random(size), {}
    for key in range(50):
        a = [dice.gauss(0, 1) for _ in range(dice.randrange(1, 60))]
        b = a[dice.randrange(len(a)) :] if key % 2 else [float(dice.randrange(3)) for _ in range(dice.randrange(1, 60))]
        own[key] = (a, b)
    rows = lambda side: spark.createDataFrame([(k, i, v) for k, x in own.items() for i, v in enumerate(x[side])], "key int, place int, value double")
    got = {}
    for r in signals.correlations(rows(0), rows(1), ["key"], 100, size).collect():
        got.setdefault(r.key, {})[r.lag] = r.score
    for key, (a, b) in own.items():
        want = direct(a, b)
        assert got[key].keys() == want.keys() and all(abs(got[key][k] - s) < 2e-6 for k, s in want.items())
    near = signals.correlations(rows(0), rows(1), ["key"], 5, size).agg(F.max(F.abs("lag")), F.count("*")).first()
    assert tuple(near) == (5, sum(abs(k) <= 5 for x in got.values() for k in x))
    best = {r.key: r.lag for r in signals.offset(rows(0), rows(1), ["key"], 100, size).collect()}
    assert all(got[k][best[k]] == max(x.values()) for k, x in got.items())


def test_signals_with_gaps(spark):
    a = spark.createDataFrame([(1, 0, 1.0), (1, 2, None), (1, 3, float("nan")), (1, 4, 5.0), (2, 0, 1.0), (3, 0, 2.0), (3, 1, 2.0), (None, 0, 1.0)], "key int, place int, value double")
    got = {r.key: (r.lag, r.score) for r in signals.offset(a, a.where("key <> 2"), ["key"], 3).collect()}
    assert got == {1: (0, 0.4), 3: (-1, 0.0)}
    assert signals.offset(a.where("false"), a, ["key"], 3).count() == 0
    for name in ("k", "n", "block", "part", "cells"):  # keys of any name
        b = a.withColumnRenamed("key", name)
        assert {r[0]: r.lag for r in signals.offset(b, b, [name], 3).collect()} == {1: 0, 2: 0, 3: -1}


def covered(a, b):
    return sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / len(a) if a else 1.0


def gaps(a, b, least):
    flags = ["0"] * len(a)
    for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        if x.size >= 2:
            flags[x.a : x.a + x.size] = "1" * x.size
    out, at = [], 0
    while at < len(a):
        end = at
        while end < len(a) and flags[end] == "0":
            end += 1
        if end - at >= least and at > 0 and end < len(a) and len(set(a[at:end])) >= 4:
            out.append((at, end))
        at = max(end, at + 1)
    return out


def test_stretches_by_walking():
    dice, n = random.Random(4), 0
    for _ in range(400):
        a, b = ("".join(dice.choices("abcdefgh", k=dice.randrange(40))) for _ in range(2))
        b = a[: dice.randrange(10)] + b + a[-dice.randrange(1, 10) :]
        assert alignment.uncovered_stretches(a, b, 5) == gaps(a, b, 5)
        blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]
        assert alignment.covered_in_order(a, b) == (sum(x.size for x in blocks) / len(a) if a else 1.0)
        n += len(gaps(a, b, 5))
    assert n > 50 and alignment.uncovered_stretches(None, "x", 5) == [] == alignment.uncovered_stretches("abcdefg", None, 5)


def plainly(lines, heard, least):
    everything, lyric = "".join(s or "" for *_, s in heard), "".join(s or "" for *_, s in lines)
    silent = {}
    for place, start, s in lines:
        if s and len(s) >= 3:
            near = "".join(t or "" for _, a, b, t in heard if start is not None and a is not None and a - 12 <= start <= max(a, b) + 12)
            best = max(covered(s, near), covered(s, everything))
            if best < 0.5:
                silent[place] = round(best, 6)
    seen, fresh = [], []
    for n, a, b, t in heard:
        near = "".join(s or "" for _, start, s in lines if a is not None and a - 15 <= start <= max(a, b) + 15) if all(x is not None for _, x, _ in lines) else ""
        for i, j in gaps(t or "", near or lyric, least):
            piece = t[i:j]
            if covered(piece, lyric) < 0.7 and not any(covered(piece, o) >= 0.6 or covered(o, piece) >= 0.6 for o in seen):
                seen.append(piece)
                fresh.append((n, i, piece))
    return silent, fresh


def test_listening(spark):
    dice, lines, heard, want = random.Random(9), [], [], {}
    for key in range(120):
        letters = dice.choice(["abcdefgh", "klmnopqrstuv"])
        word = lambda k, own=letters: "".join(dice.choices(own, k=k))
        a = [(p, None if key % 4 == 3 and p == 1 else p * 9.0, dice.choice([None, "", word(2), *[word(dice.randrange(5, 25)) for _ in range(5)]])) for p in range(dice.randrange(1, 9))]
        b = []
        for n in range(dice.randrange(7)):
            own = [s or "" for _, _, s in a]
            strange = dice.choice(["", "uvwxyz0123", "wxyz98765", word(9)])
            b.append((n, n * 11.0 if n != 5 else None, n * 11.0 + 14, dice.choice([None, "", dice.choice(own) + strange + dice.choice(own), dice.choice(own)[:9] + strange + dice.choice(own)])))
        lines += [(key, *x) for x in a]
        heard += [(key, *x) for x in b]
        want[key] = plainly(a, b, 6)
    left = spark.createDataFrame(lines, "key int, place int, start double, sound string")
    right = spark.createDataFrame(heard, "key int, n int, start double, end double, sound string")
    silent, fresh = {k: {} for k in want}, {k: [] for k in want}
    for r in listening.unheard(left, right, ["key"]).collect():
        silent[r.key][r.place] = round(r.share, 6)
    for r in listening.unwritten(left, right, ["key"], 6).collect():
        fresh[r.key].append((r.n, r.at, r.piece))
    assert {k: (silent[k], sorted(fresh[k])) for k in want} == want
    assert sum(map(len, silent.values())) > 10 and sum(map(len, fresh.values())) > 10
    assert listening.unheard(left.where("false"), right, ["key"]).count() == 0 == listening.unwritten(left, right.where("false"), ["key"], 6).count()
