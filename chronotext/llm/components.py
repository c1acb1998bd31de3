"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of one node's neighbours are dealt to so many tasks.
SALTS = 8


def _least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least of u's v and u itself; hubs are spread by salt."""
    least = pairs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    least = least.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return pairs.withColumn("salt", F.pmod("v", F.lit(SALTS)).cast("int")).join(least, ["u", "salt"])


def _round(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = _least(large)
    return small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b), both long: root is the least node that
    can be reached. Each round is written to the shared folder; rounds grow as the
    logarithm of the longest path. Links from a node to itself are ignored."""
    now = common.written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    seen = mark(now)
    while seen[0]:
        now = common.written(_round(now), "links")
        if (then := mark(now)) == seen:
            break
        seen = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
