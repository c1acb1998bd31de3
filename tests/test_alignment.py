"""Dynamic programs and greedy matching against plain versions."""

import difflib
import random
from functools import lru_cache

import pytest
from compare import difference
from pyspark.sql import functions as F

from chronotext.operators import alignment, one_to_one
from chronotext.plans import aligned

SF = "/root/testdata/sf0.001"
dice = random.Random(5)
PAIRS = [("", ""), ("a", ""), ("", "a")] + [tuple("".join(dice.choices("abc", k=dice.randrange(9))) for _ in range(2)) for _ in range(120)]


@pytest.mark.parametrize("name", sorted(aligned.SQL))
def test_sql(spark, name):
    assert difference(spark, aligned.QUERIES[name], aligned.SQL[name], SF) == ""


def least(a, b, miss, spare, other):
    """Cost of pairing all of a with all of b, by the definition."""

    @lru_cache(None)
    def at(i, j):
        if i == len(a) or j == len(b):
            return (len(a) - i) * miss + (len(b) - j) * spare
        return min(at(i + 1, j) + miss, at(i, j + 1) + spare, at(i + 1, j + 1) + (0 if a[i] == b[j] else other))

    return at(0, 0)


def test_programs_by_force():
    for a, b in PAIRS:
        assert alignment.pairing_cost(a, b) == least(a, b, 1000, 300, 1300)
        stretches = [b[i:j] for i in range(len(b) + 1) for j in range(i, len(b) + 1)]
        want = min(least(a, s, 1, 1, 1) for s in stretches) / len(a) if a and b else 1.0
        assert alignment.distance_within(a, b) == want
        blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        assert alignment.covered_in_order(a, b) == (sum(x.size for x in blocks) / len(a) if a else 1.0)
    assert alignment.covered_in_order(None, ["x"]) == 1.0 and alignment.distance_within(["x"], None) == 1.0


def greedy_by_force(left, right, tolerance):
    free, out = set(right), set()
    for t, own in sorted(left):
        near = sorted((abs(u - t), u, i) for u, i in free if abs(u - t) <= tolerance)
        if near:
            gap, u, i = near[0]
            free.remove((u, i))
            out.add((own, i, gap))
    return out


def test_greedy_by_force(spark):
    for _ in range(100):
        left, right = ([(dice.randrange(60), i) for i in range(dice.randrange(15))] for _ in range(2))
        assert set(one_to_one.greedy_pairs(left, right, 4)) == greedy_by_force(left, right, 4)
    rows = {k: [[(dice.randrange(300), i + 100 * s) for i in range(30)] for s in (0, 1)] for k in ("a", "b")}
    left, right = (spark.createDataFrame([(k, i, t) for k, v in rows.items() for t, i in v[s]], "k string, id long, t long") for s in (0, 1))
    got = {k: set() for k in rows}
    for r in one_to_one.greedy_nearest(left, right, ["k"], 4).collect():
        got[r.k].add((r.left_id, r.right_id, r.gap))
    assert got == {k: greedy_by_force(*v, 4) for k, v in rows.items()}
    assert one_to_one.greedy_nearest(left.where("false"), right, ["k"], 4).count() == 0


def test_rows_without_sql(spark):
    by_hand = {(r.conv_id, r.turn): r.cost for r in aligned.monotone_pairing(spark, SF).collect()}
    rows = aligned._asked_and_answered(spark, SF).collect()
    assert by_hand == {(r.conv_id, r.turn): alignment.pairing_cost(r.own, r.after) for r in rows}
    assert all(0 <= r.distance <= 1 for r in aligned.substring_distance(spark, SF).collect())
    got = aligned.ordered_coverage(spark, SF)
    assert got.where(~F.col("share").between(0.3, 1)).count() == 0 and got.count() > 0
