"""Medians, quantiles and deviations that no key's size can break.

Equal values are folded before the shuffle, and ranks come from running counts in a window
that spills, not from lists or maps of all values of a key.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float], upper: bool = False) -> DataFrame:
    """(by, n, one column per wanted quantile), interpolated linearly between ranks; with
    upper the higher of the two ranks is taken. Null values are left out, a key without others
    gives no row, a null key is a key. Keys may have any name but n and the wanted ones."""
    keys = [f"_key_{i}" for i in range(len(by))]
    w = Window.partitionBy(*keys)
    named = rows.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).alias("_v"))
    c = named.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_k"))
    c = c.withColumn("_upto", F.sum("_k").over(w.orderBy("_v"))).withColumn("_n", F.sum("_k").over(w))
    out = []
    for name, p in wanted.items():
        at = (F.col("_n") * F.lit(p)) if upper else (F.col("_n") - 1) * F.lit(p)
        low = F.min(F.when(F.col("_upto") > F.floor(at), F.col("_v")))
        if upper:
            out.append(low.alias(name))
        else:
            high = F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_v")))
            part = F.first(at - F.floor(at))
            out.append((low + (high - low) * part).alias(name))
    found = c.groupBy(*keys).agg(F.first("_n").alias("n"), *out)
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "n", *wanted)


def deviations(rows: DataFrame, by: list[str], value: str, least: int = 8, widest: float = 0.35) -> DataFrame:
    """rows with n, centre (upper median), spread (upper median of absolute residuals), limit
    and flagged: residual above min(1, max(0.4, 6 * spread)), where a key has at least
    ``least`` rows and a spread of at most ``widest``. Rows whose value is null are left out;
    the caller's columns of these five names give way to them."""
    own = [c for c in rows.columns if c not in ("n", "centre", "spread", "limit", "flagged") or c in (*by, value)]
    packed = rows.where(F.col(value).isNotNull()).select(*[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)], F.col(value).alias("_value"), F.struct(*[F.col(c) for c in own]).alias("_row"))
    keys = [f"_by_{i}" for i in range(len(by))]
    centre = quantiles(packed, keys, "_value", {"centre": 0.5}, upper=True)
    on = lambda a, b: functools.reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    around = packed.join(centre, on(packed, centre)).select(*[packed[k] for k in keys], "_row", "n", "centre", F.abs(F.col("_value") - F.col("centre")).alias("_off"))
    spread = quantiles(around, keys, "_off", {"spread": 0.5}, upper=True).drop("n")
    limit = F.least(F.lit(1.0), F.greatest(F.lit(0.4), 6 * F.col("spread")))
    judged = (F.col("n") >= least) & (F.col("spread") <= widest)
    both = around.join(spread, on(around, spread))
    return both.select("_row.*", "n", "centre", "spread", limit.alias("limit"), (judged & (F.col("_off") > limit)).alias("flagged"))
