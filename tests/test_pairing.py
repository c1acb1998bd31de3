"""Pairings within windows and symbols on frames, against plain tables and enumeration."""

import itertools
import random

import numpy as np
import pytest

from chronotext.operators import framewise, pairing
from chronotext.plans import folding

SF = "/root/testdata/sf0.001"


def price(at, due, steep):
    if due < 0:
        return 0
    return min(999, max(0, abs(at - due) - 25) * 8) if steep else min(999, abs(at - due) // 5)


def joint(mode, a, b, at, due):
    """(cost of stepping over a and b together, whether that is a pair), None if it isn't allowed."""
    if mode == "sounds":
        same = (a[0] == b[0]) + (a[1] == b[1])
        return (price(at, due, False) + (0 if same == 2 else 350), True) if same else None
    return (price(at, due, mode == "steep"), True) if a == b else (1000 + (300 if mode == "steep" else 1000), False)


def paired(mode, a, b, low, high, due, at):
    """The full table, and the way back by the stated order of ways."""
    spare = 1000 if mode == "gentle" else 300
    step = lambda i, j: joint(mode, a[i], b[j], at[j], due[i]) if low[i] <= j <= high[i] else None
    cost = {}
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        ways = ([cost[i - 1, j] + 1000] if i else []) + ([cost[i, j - 1] + spare] if j else [])
        if i and j and (s := step(i - 1, j - 1)):
            ways.append(cost[i - 1, j - 1] + s[0])
        cost[i, j] = min(ways, default=0)
    out, i, j = [-1] * len(a), len(a), len(b)
    while i and j:
        s = step(i - 1, j - 1)
        both = s is not None and cost[i, j] == cost[i - 1, j - 1] + s[0]
        up, left = cost[i, j] == cost[i - 1, j] + 1000, cost[i, j] == cost[i, j - 1] + spare
        if both and (mode != "sounds" or not up and not left):
            out[i - 1] = j - 1 if s[1] else -1
            i, j = i - 1, j - 1
        elif up:
            i -= 1
        else:
            j -= 1
    return out, cost[len(a), len(b)]


def best_of_all(mode, a, b, low, high, due, at):
    """The least cost over all monotone pairings."""
    spare, best = 1000 if mode == "gentle" else 300, 10**9
    for k in range(min(len(a), len(b)) + 1):
        for x in itertools.combinations(range(len(a)), k):
            for y in itertools.combinations(range(len(b)), k):
                steps = [joint(mode, a[i], b[j], at[j], due[i]) if low[i] <= j <= high[i] else None for i, j in zip(x, y)]
                if all(s and s[1] for s in steps):
                    best = min(best, sum(s[0] for s in steps) + 1000 * (len(a) - k) + spare * (len(b) - k))
    return best


def case(dice, mode, most):
    symbol = (lambda: (dice.randrange(3), dice.randrange(3))) if mode == "sounds" else (lambda: dice.choice("abc"))
    a, b = [symbol() for _ in range(dice.randrange(most))], [symbol() for _ in range(dice.randrange(most))]
    low = [dice.randrange(-2, max(1, len(b))) for _ in a]
    return a, b, low, [x + dice.randrange(most) for x in low], [dice.choice([-1, dice.randrange(300)]) for _ in a], sorted(dice.randrange(300) for _ in b)


def own(mode, *args):
    return pairing.pair_sounds(*args) if mode == "sounds" else pairing.pair(*args, mode == "steep")


@pytest.mark.parametrize("mode", ["gentle", "steep", "sounds"])
def test_pairs_by_table(mode):
    dice = random.Random(11)
    for _ in range(250):
        args = case(dice, mode, 14)
        assert own(mode, *args) == paired(mode, *args)[0]
    for _ in range(120):
        args = case(dice, mode, 6)
        assert paired(mode, *args)[1] == best_of_all(mode, *args)


@pytest.mark.parametrize("name", ["windowed_pairs", "sound_pairs"])
def test_queries_by_table(spark, name):
    rows = folding._asked(spark, SF).collect()
    got = {(r.conv_id, r.turn): r for r in folding.QUERIES[name](spark, SF).collect()}
    assert len(got) == len(rows)
    family = {r.word.lower(): (r.family, r.vowel) for r in folding.word_sounds(spark, SF).collect()}
    for r in sorted(rows, key=lambda r: len(r.lyric) * len(r.heard))[:25]:
        n = len(r.lyric)
        pace = [i * len(r.heard) // n for i in range(n)]
        rest = ([p - 20 for p in pace], [p + 20 for p in pace], [-1 if i % 5 == 4 else p * 10 for i, p in enumerate(pace)], [i * 10 for i in range(len(r.heard))])
        text = lambda x: ",".join(map(str, x))
        if name == "sound_pairs":
            if all(w in family for w in (*r.lyric, *r.heard)):
                sound = [[family[w] for w in side] for side in (r.lyric, r.heard)]
                assert got[r.conv_id, r.turn].partners == text(paired("sounds", *sound, *rest)[0])
        else:
            for mode in ("gentle", "steep"):
                assert got[r.conv_id, r.turn][mode] == text(paired(mode, r.lyric, r.heard, *rest)[0])


def test_long_sides_in_little_memory():
    import tracemalloc

    dice = random.Random(12)
    a, b = [dice.randrange(20) for _ in range(1500)], [dice.randrange(20) for _ in range(4000)]
    tracemalloc.start()
    got = pairing.pair(a, b, [0] * 1500, [4000] * 1500, [-1] * 1500, list(range(4000)), True)
    assert tracemalloc.get_traced_memory()[1] < 12_000_000  # the whole table has 48 MB
    assert [j for j in got if j >= 0] == sorted(j for j in got if j >= 0)


def all_paths(frames, symbols, low, high, rule):
    """Every way to go through symbols and blanks: (state of each frame), state 2 k + 1 being
    symbol k and 2 k the blank before it."""
    n = len(symbols)
    paths = [[0]] + ([[1]] if low[0] <= 0 <= high[0] else [])
    for f in range(1, frames):
        longer = []
        for p in paths:
            s = p[-1]
            for t in (s, s + 1, s + 2):
                if t > 2 * n or t == s + 2 and (s % 2 == 0 or symbols[s // 2] == symbols[t // 2 if t < 2 * n else -1]):
                    continue
                if t % 2 and (t != s or rule == "held") and not low[t // 2] <= f <= high[t // 2]:
                    continue
                longer.append([*p, t])
        paths = longer
    return [p for p in paths if p[-1] >= 2 * n - 1]


def by_enumeration(scores, symbols, low, high, rule):
    paths = all_paths(len(scores), symbols, low, high, rule)
    if not paths:
        return None
    worth = lambda p: sum(scores[f, symbols[s // 2] if s % 2 else 0] for f, s in enumerate(p))
    # of equal paths: the later state at the end, and again and again the later one going back,
    # which is to stay rather than to come from the state before, and from that than from two before
    best = max(paths, key=lambda p: (worth(p), p[::-1]))
    return [next(f for f, s in enumerate(best) if s == 2 * k + 1) for k in range(len(symbols))]


@pytest.mark.parametrize("rule", ["held", "entered"])
def test_frames_by_enumeration(rule):
    rng = np.random.default_rng(13)
    none = 0
    for i in range(500):
        frames, symbols = int(rng.integers(1, 8)), rng.integers(1, 3, rng.integers(1, 4)).tolist()
        low = rng.integers(0, 4, len(symbols)).tolist()
        high = [x + int(rng.integers(0, 4)) for x in low]
        scores = rng.integers(-2, 1, (frames, 3)).astype(float) if i % 2 else rng.normal(size=(frames, 3))
        want = by_enumeration(scores, symbols, low, high, rule)
        assert framewise.first_frames(scores, symbols, low, high, rule=rule) == want
        none += want is None
    assert 20 < none < 450


def test_many_frames_hold_a_band():
    import tracemalloc

    frames, n = 100_000, 2000
    rng = np.random.default_rng(14)
    scores = rng.normal(size=(frames, 4)).astype(np.float32)
    due = np.arange(n) * (frames // n)
    tracemalloc.start()
    starts = framewise.first_frames(scores, rng.integers(1, 4, n), due - 100, due + 100, rule="entered")
    assert tracemalloc.get_traced_memory()[1] < 40_000_000  # 200 MB for all states, a byte each
    assert (abs(np.array(starts) - due) <= 100).all() and (np.diff(starts) > 0).all()


def test_pairs_of_long_sides_in_time():
    import time
    import tracemalloc

    tracemalloc.stop()
    dice = random.Random(13)
    a, b = [dice.randrange(90) for _ in range(4000)], [dice.randrange(90) for _ in range(4000)]
    began = time.process_time()
    got = pairing.pair(a, b, [i - 20 for i in range(4000)], [i + 20 for i in range(4000)], [i * 10 for i in range(4000)], [i * 10 for i in range(4000)], False)
    assert time.process_time() - began < 0.5
    assert all(j < 0 or a[i] == b[j] and abs(i - j) <= 20 for i, j in enumerate(got)) and sum(j >= 0 for j in got) > 400


def test_sounds_in_little_memory(spark):
    import tracemalloc

    import pyarrow as pa

    sound = pa.array([[{"family": k % 5, "vowel": k % 3} for k in range(40)]] * 4000)
    numbers = pa.array([list(range(40))] * 4000, pa.list_(pa.int32()))
    wide = pa.array([[60] * 40] * 4000, pa.list_(pa.int32()))
    run = pairing.paired("sounds").func
    tracemalloc.start()
    (got,) = list(run(iter([(sound, sound, numbers, wide, numbers, numbers)])))
    assert tracemalloc.get_traced_memory()[1] < 10_000_000
    tracemalloc.stop()
    assert len(got) == 4000 and got[0].as_py() == list(range(40))
