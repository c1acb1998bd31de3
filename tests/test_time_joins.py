"""Nearness in time against plain versions, and keys of many rows."""

import random

import pytest
from pyspark.sql import functions as F

from chronotext.operators import one_to_one, sequences, time_joins

SCHEMA = "user int, id long, t long"


def sides(seed, n):
    dice = random.Random(seed)
    make = lambda: [(dice.choice([1, 2, None]), i, dice.choice([None, *range(30)]) if dice.random() < 0.2 else dice.randrange(60)) for i in range(n)]
    return make(), make()


@pytest.mark.parametrize("by_id", [False, True])
@pytest.mark.parametrize("tolerance", [2, None])
def test_nearest(spark, by_id, tolerance):
    left, right = sides(3, 80)
    got = {r.id: (r.match_id, r.gap) for r in time_joins.nearest(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["user"], tolerance, by_id).collect()}
    for user, own, t in left:
        near = [(abs(u - t), *((i,) if by_id else (u, i)), i) for k, i, u in right if k == user and t is not None and u is not None]
        best = min((x for x in near if tolerance is None or x[0] <= tolerance), default=None)
        if t is not None:
            assert got[own] == ((best[-1], best[0]) if best else (None, None)), (own, t)


def test_nearest_other(spark):
    rows = [r for r in sides(5, 120)[0] if r[2] is not None] + [(7, 500, 3), (7, 501, 3), (8, 502, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", match_id string")
    got = {r.id: (r.match_id, r.gap) for r in time_joins.nearest_other(df, ["user"], 2).collect()}
    assert len(got) == len(rows)
    for user, own, t in rows:
        best = min(((abs(u - t), i) for k, i, u in rows if k == user and i != own and abs(u - t) <= 2), default=(None, None))
        assert got[own] == (best[1], best[0])
    assert time_joins.nearest_other(df.where("false"), ["user"], 2).count() == 0


def test_one_key_of_many_rows(spark):
    """Frames to the end of a key would take hours here."""
    n = 200_000
    a = spark.range(n).select(F.lit(1).alias("user"), "id", (F.col("id") * 7 % 1000003).alias("t"))
    b = spark.range(n).select(F.lit(1).alias("user"), "id", (F.col("id") * 11 % 1000003).alias("t"))
    assert time_joins.nearest(a, b, ["user"], None).where("match_id is not null").count() == n
    assert time_joins.nearest_other(a, ["user"], 10**9).where("match_id is not null").count() == n
    assert one_to_one.first_in_band(a, b, ["user"], 10**7).where("match_id is not null").count() == n
    low, high = sequences.bounds("t", ["user"], ["t", "id"])
    follow = sequences.next_known(None, ["user"], ["t", "id"], F.when(F.col("id") % 3 == 0, F.col("t")))
    got = a.select("t", low.alias("low"), high.alias("high"), follow.alias("follow")).agg(F.count_if(F.expr("low <= t and high >= t")), F.count_if(F.expr("follow >= t"))).first()
    assert got[0] == n and n - 20 < got[1] < n
