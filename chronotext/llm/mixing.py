"""Mixing sources to target weights by repetition.

Tokens (words) are added up per source; each source gets a target, from which its
repetition rate follows. A document is emitted floor(rate) times, plus once more if a
number in [0, 1) that is hashed from seed and document lies below the rate's fraction.

Only DataFrame operations are used. Sizes are partially aggregated before the shuffle; what
is ranked and broadcast is one row per source, never documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A source takes at most this many times its own size.
MOST = 3
#: A sources table of at most this many rows is broadcast (a name, a few numbers: 10 MB).
BROADCAST_SOURCES = 100_000


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """A weight for each source by its place in code point order, null last, repeating."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")))


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Targets of sources (source, source_size, weight): shares of the sum of all sizes by
    weight, none above most * source_size, the excess shared by weight among the others.

    Sharing again and again ends where sources are capped in ascending order of
    size / weight; the first k in that order are capped, with the least k for which the
    next one's share fits. A weight of 0 or null takes nothing."""
    ratio = F.when(F.col("weight") > 0, F.col("source_size") / F.col("weight"))
    order = Window.orderBy(F.col("ratio").asc_nulls_last(), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    got = (
        sources.withColumn("ratio", ratio)
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("capped_before", F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most)
        .withColumn("weights_before", F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.col("total") - F.col("capped_before"))
        .withColumn("weights_left", F.col("weights") - F.col("weights_before"))
        .withColumn("fits", F.col("left") * F.col("weight") <= most * F.col("source_size") * F.col("weights_left"))
    )
    level = F.min(F.when(F.col("fits") & (F.col("weight") > 0), F.struct("ratio", "capped_before", "left", "weights_left"))).over(whole)
    got = got.withColumn("level", level)
    below = F.col("level").isNull() | (F.col("ratio") < F.col("level.ratio"))
    share = F.col("level.left") * F.col("weight") / F.col("level.weights_left")
    target = F.when(F.col("ratio").isNull(), F.lit(0.0)).when(below, (most * F.col("source_size")).cast("double")).otherwise(share.cast("double"))
    return got.select("source", "source_size", "weight", target.alias("target"))


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) from the leading 52 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") / float(2**52)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, most: int = MOST, seed: int = 17) -> DataFrame:
    """docs packed as ``row``, with id, size, source_size, target, rate and copies of each.

    weights (source, weight) defaults to cycled_weights. A source that weights lacks takes
    nothing. A source whose documents are all empty has target and rate 0, and copies 0.
    A null text has size 0; null sources form one source. Rows with equal ids are drawn
    alike, rows without id by their text. An empty table gives no rows."""
    text = common.text_of(text_col)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), common.word_count(text).alias("size"))
    sources = docs.select(F.col(source_col).alias("source"), common.word_count(text).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        weighted = cycled_weights(sources)
    else:
        w = weights.select(F.col("source").alias("w_source"), "weight").dropDuplicates(["w_source"])
        weighted = sources.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").select("source", "source_size", F.coalesce("weight", F.lit(0)).alias("weight"))
    aims = common.written(targets(weighted, most), "mix-targets").withColumnRenamed("source", "aim_source")
    if aims.count() <= BROADCAST_SOURCES:
        aims = F.broadcast(aims)
    key = F.coalesce(F.col("id").cast("string"), F.md5(common.text_of(F.col("row").getField(text_col))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor("rate") + (uniform(seed, key) < F.col("rate") - F.floor("rate")).cast("long")
    return rows.join(aims, F.col("source").eqNullSafe(F.col("aim_source"))).withColumn("rate", rate).withColumn("copies", copies)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixture: each row of docs as often as the plan says, with docs' columns."""
    return plan(docs, **how).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
