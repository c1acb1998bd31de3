"""Joins whose left side may have one key in a large share of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it has more than 1 / SHARES of all rows, so fewer than SHARES keys are.
SHARES = 4096


def joined(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """The inner join of left with right, which has one row for each key; weight, a column of
    right that is not in the result, is the number of left's rows that have the key.

    Heavy keys, fewer than SHARES of them whatever the size, are joined by broadcast and never
    shuffled; any other key has at most 1 / SHARES of the rows. Null keys match nothing. left
    and right are read more than once, so they should be written tables."""
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    heavy = F.broadcast(right.where(F.col(weight) * SHARES > total).drop(weight))
    light = right.where(F.col(weight) * SHARES <= total).drop(weight)
    return left.join(heavy, key).unionByName(left.join(heavy.select(key), key, "left_anti").join(light, key))
