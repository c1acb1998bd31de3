"""Joins by nearness in time. None of them compares all pairs of a key.

Sides are DataFrames with key columns ``by``, a long ``t`` and a unique ``id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, by: list[str], tolerance: int | None, by_id: bool = False) -> DataFrame:
    """left with match_id and gap of the nearest right row within tolerance (null if none; no
    bound without one); of equally near ones the earlier, or with by_id the one with the smaller
    id; at one time always the one with the smaller id.

    A row's neighbours are running last values of both sides sorted together, from either end (a
    frame that reaches to the end of a key would be summed up anew for each row), so the work is
    that of two sorts however many rows a key has or lie within the tolerance.
    Columns of left keep their names and values; only match_id and gap are replaced."""
    key = lambda df: [F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)]
    at = [F.col("t").alias("_t"), F.col("id").alias("_id")]
    a = left.select(*key(left), *at, F.lit(0).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    b = right.select(*key(right), *at, F.lit(1).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    own = F.when(F.col("_side") == 1, F.struct(F.col("_t").alias("t"), F.col("_id").alias("id")))
    order = Window.partitionBy(*[f"_by_{i}" for i in range(len(by))])
    both = both.withColumn("_same", F.min(own).over(order.orderBy("_t").rangeBetween(0, 0)))
    found = F.when(F.col("_side") == 1, F.col("_same"))
    before = F.last(found, ignorenulls=True).over(order.orderBy("_t", F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(found, ignorenulls=True).over(order.orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_before", before).withColumn("_after", after).where("_side = 0")
    x, y = F.col("_t") - F.col("_before.t"), F.col("_after.t") - F.col("_t")
    pick = F.when(y.isNull() | (x < y) | (x == y) & (F.col("_before.id") <= F.col("_after.id") if by_id else F.lit(True)), F.struct(F.col("_before.id").alias("id"), x.alias("gap"))).otherwise(F.struct(F.col("_after.id").alias("id"), y.alias("gap")))
    both = both.withColumn("_pick", pick)
    near = F.col("_pick.gap") <= tolerance if tolerance is not None else F.col("_pick.gap").isNotNull()
    kept = [F.col("_row").getField(c).alias(c) for c in left.columns if c not in ("match_id", "gap")]
    return both.select(*kept, F.when(near, F.col("_pick.id")).alias("match_id"), F.when(near, F.col("_pick.gap")).alias("gap"))


def nearest_other(rows: DataFrame, by: list[str], tolerance: int) -> DataFrame:
    """rows with match_id and gap of the nearest other row of the same key within tolerance
    (null if none); of equally near ones the one with the smaller id. Null ids match nothing."""
    order = Window.partitionBy(*[F.col(c) for c in by])
    same = order.orderBy("t").rangeBetween(0, 0)
    both = rows.withColumn("_first", F.min("id").over(same))
    both = both.withColumn("_second", F.min(F.when(F.col("id") != F.col("_first"), F.col("id"))).over(same))
    at = F.when(F.col("_first").isNotNull(), F.struct("t", F.col("_first").alias("id")))
    before = F.last(at, ignorenulls=True).over(order.orderBy("t").rangeBetween(Window.unboundedPreceding, -1))
    after = F.last(at, ignorenulls=True).over(order.orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("_before", before).withColumn("_after", after)
    twin = F.when(F.col("id") == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))
    option = lambda gap, i: F.when(gap.isNotNull() & i.isNotNull(), F.struct(gap.alias("gap"), i.alias("id")))
    options = F.array(option(F.col("t") - F.col("t"), twin), option(F.col("t") - F.col("_before.t"), F.col("_before.id")), option(F.col("_after.t") - F.col("t"), F.col("_after.id")))
    pick = F.array_min(F.array_compact(options))
    near = (pick["gap"] <= tolerance) & F.col("id").isNotNull()
    kept = [c for c in rows.columns if c not in ("match_id", "gap")]
    return both.select(*kept, F.when(near, pick["id"]).alias("match_id"), F.when(near, pick["gap"]).alias("gap"))


def mutual_nearest(left: DataFrame, right: DataFrame, by: list[str], tolerance: int) -> DataFrame:
    """(by, left_id, right_id, gap) of rows that are each other's nearest."""
    a = nearest(left, right, by, tolerance).where("match_id is not null").select(*by, F.col("id").alias("left_id"), F.col("match_id").alias("right_id"), "gap")
    b = nearest(right, left, by, tolerance).where("match_id is not null").select(F.col("id").alias("right_id"), F.col("match_id").alias("left_id"))
    return a.join(b, ["left_id", "right_id"]).select(*by, "left_id", "right_id", "gap")


def counts_in_band(left: DataFrame, right: DataFrame, by: list[str], before: int, after: int) -> DataFrame:
    """left with n, the number of right rows with t in [t - before, t + after]: a running
    count at the band's ends, not a join."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    plus = left.select(*by, "id", (F.col("t") + after).alias("t"), zero.alias("own"), one.alias("sign"))
    minus = left.select(*by, "id", (F.col("t") - before - 1).alias("t"), zero.alias("own"), (-one).alias("sign"))
    points = plus.unionByName(minus).unionByName(right.select(*by, "id", "t", one.alias("own"), zero.alias("sign")))
    run = F.sum("own").over(Window.partitionBy(*by).orderBy("t").rangeBetween(Window.unboundedPreceding, 0))
    n = points.withColumn("run", run).where("sign <> 0").groupBy("id").agg(F.sum(F.col("run") * F.col("sign")).alias("n"))
    return left.join(n, "id")


def upsert(fresh: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Rows of fresh, and those of old whose key fresh lacks."""
    return fresh.unionByName(old.join(fresh.select(*key), key, "left_anti"))


def migrate_keys(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """rows with key replaced by mapping's (old, new) where it has one."""
    m = mapping.select(F.col("old").alias(key), F.col("new").alias("_new"))
    return rows.join(m, key, "left").withColumn(key, F.coalesce("_new", key)).drop("_new")


def contained(parts: DataFrame, texts: DataFrame, n: int, least: float, grams: Column) -> DataFrame:
    """(item_id, doc_id, share) where at least that share of an item's distinct n-grams occur
    in a text. parts (item_id, items), texts (doc_id, items); grams maps the column items.

    Grams meet as 64-bit hashes, with those of texts reduced to ones that an item has before
    anything is shuffled by document (Spark broadcasts the items' grams if they are small);
    equal hashes are held against the grams themselves, once for each distinct gram."""
    p = parts.select("item_id", grams.alias("g")).withColumn("total", F.size("g")).select("item_id", "total", F.explode("g").alias("gram"))
    p = p.withColumn("hash", F.xxhash64("gram"))
    wanted = p.select("hash", "gram").distinct().groupBy("hash").agg(F.collect_set("gram").alias("own"))
    d = texts.select("doc_id", F.explode(grams).alias("gram")).withColumn("hash", F.xxhash64("gram"))
    d = d.join(wanted, "hash").where(F.array_contains("own", F.col("gram"))).select("doc_id", "hash", "gram")
    hits = d.join(p, ["hash", "gram"]).groupBy("item_id", "doc_id").agg((F.count(F.lit(1)) / F.first("total")).alias("share"))
    return hits.where(F.col("share") >= least)
