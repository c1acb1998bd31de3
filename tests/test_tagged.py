"""Rows with stamps inside, frame alignment and pairings against plain versions."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronotext import catalog
from chronotext.functions import timecodes
from chronotext.operators import alignment, framewise

SF = "/root/testdata/sf0.001"
dice = random.Random(8)


def test_timed_parts(spark):
    rows = [("a", "[00:01:50]he[00:02.250]llo[00:03:00]"), ("b", "lead[00:01:00]end"), ("c", "plain"), ("d", ""), ("e", None), ("f", "[00:01:00][00:02:00]x [1:2]"), ("g", "[00:05:00]")]
    df = spark.createDataFrame(rows, "k string, row string")
    parts = lambda **how: {r.k: r.p and [tuple(x) for x in r.p] for r in df.select("k", timecodes.timed_parts(F.col("row"), **how).alias("p")).collect()}
    assert parts() == {"a": [("he", 1.5, 2.25), ("llo", 2.25, 3.0)], "b": [("lead", 0.0, 1.0), ("end", 1.0, 1.0)], "c": [("plain", 0.0, 0.0)], "d": [], "e": None, "f": [("x [1:2]", 2.0, 2.0)], "g": []}
    assert parts(origin=10.0, last_end=F.lit(20.0))["b"] == [("lead", 10.0, 11.0), ("end", 11.0, 20.0)]


def test_rows_that_read_differently_are_refused(spark):
    df = spark.createDataFrame([([("a", 0.0), ("b", 0.5)],), ([("x[", 0.0)],), ([],), (None,)], "p array<struct<text:string,start:double>>")
    assert [r[0] for r in df.select(timecodes.tagged(F.col("p"), F.lit(1.0))).collect()] == ["[00:00:00]a[00:00:50]b[00:01:00]", None, "[00:01:00]", None]


def best_by_force(scores, symbols, low, high):
    """Starts of the best of all ways to label the frames, by the definition."""
    best = (-np.inf, None)
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        starts, k, ok = [], -1, True
        for f, s in enumerate(path):
            if s and (f == 0 or path[f - 1] != s):
                k += 1
                starts.append(f)
            ok = ok and (not s or (k < len(symbols) and symbols[k] == s and low[k] <= f <= high[k]))
        if ok and k + 1 == len(symbols):
            best = max(best, (sum(scores[f, s] for f, s in enumerate(path)), starts))
    return best[1]


def test_frames_by_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        frames, symbols = int(rng.integers(1, 7)), rng.integers(1, 3, rng.integers(1, 4)).tolist()
        low = sorted(rng.integers(0, 3, len(symbols)).tolist())
        high = sorted(rng.integers(1, 7, len(symbols)).tolist())
        scores = rng.normal(size=(frames, 3))
        assert framewise.first_frames(scores, symbols, low, high) == best_by_force(scores, symbols, low, high)
    assert framewise.first_frames(np.zeros((0, 3)), []) == [] and framewise.first_frames(np.zeros((0, 3)), [1]) is None


def test_frames_edges(spark):
    kind = "k string, s array<double>, y array<int>, lo array<int>, hi array<int>"
    s = [0.0, 1.0, 0.0, 1.0, 0.0]
    rows = [("plain", s, [1], None, None), ("no scores", None, [1], None, None), ("null within", [0.0, None], [1], None, None), ("null symbol", s, [None], None, None), ("outside", s, [2], None, None), ("none", s, [], None, None), ("too many", s, [1, 1, 1], None, None), ("late", s, [1], [1], [1]), ("no window", s, [1], [2], [1])]
    got = {r.k: r.x for r in spark.createDataFrame(rows, kind).select("k", framewise.placed(2)("s", "y", "lo", "hi").alias("x")).collect()}
    assert got == {"plain": [0], "no scores": None, "null within": None, "null symbol": None, "outside": None, "none": [], "too many": None, "late": [1], "no window": None}


def test_pairs_have_least_cost():
    for _ in range(200):
        a, b = ("".join(dice.choices("abc", k=dice.randrange(10))) for _ in range(2))
        pairs = alignment.pairs_in_order(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert alignment.pairing_cost(a, b) == 1000 * (len(a) - len(pairs)) + 300 * (len(b) - len(pairs))
    assert alignment.pairs_in_order(None, ["x"]) == [] == alignment.pairs_in_order(["x"], [])


@pytest.mark.parametrize("name", ["ctc_alignment", "monotone_pairs"])
def test_queries_by_force(spark, name):
    got = catalog.queries()[name](spark, SF).collect()
    if name == "monotone_pairs":
        turns = pd.read_parquet(f"{SF}/conversations.parquet").sort_values(["conv_id", "turn"])
        want = set()
        for conv, g in turns.groupby("conv_id"):
            own = [[w for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())] for t in g.text]
            for turn, a, b in zip(g.turn, own, own[1:]):
                want |= {(conv, turn, i, j, a[i]) for i, j in alignment.pairs_in_order(a, b)}
        assert {tuple(r) for r in got} == want and len(got) == len(want)
        return
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert len(got) == len(vectors)
    for r in got:
        wanted = [r.vec_id // 7**k % 7 + 1 for k in range(3)]
        scores = np.array(vectors[r.vec_id], np.float64).reshape(-1, 8)
        assert r.symbols == ",".join(map(str, wanted))
        assert r.starts == ",".join(map(str, framewise.first_frames(scores, wanted, range(3))))
