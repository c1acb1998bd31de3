"""Runs, bounds and neighbours in ordered rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def islands(rows: DataFrame, by: list[str], order: list[str], breaks: Column) -> DataFrame:
    """rows with ``island``: a number that grows by one where ``breaks`` (over the window)
    is true; null and the first row count as no break. A column island of the caller's is
    refused."""
    if "island" in rows.columns:
        raise ValueError("rows have a column named island")
    w = Window.partitionBy(*by).orderBy(*order)
    marked = rows.select("*", F.coalesce(breaks, F.lit(False)).cast("int").alias("__break"))
    return marked.select(*rows.columns, F.sum("__break").over(w).cast("long").alias("island"))


def gap_runs(rows: DataFrame, by: list[str], gap: int, least: int = 1) -> DataFrame:
    """(by, started, ended, n) of runs of rows (t, id) no more than gap apart, least rows long."""
    w = Window.partitionBy(*by).orderBy("t", "id")
    marked = islands(rows, by, ["t", "id"], F.col("t") - F.lag("t").over(w) > gap)
    runs = marked.groupBy(*by, "island").agg(F.min("t").alias("started"), F.max("t").alias("ended"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("n") >= least).drop("island")


def index_blocks(rows: DataFrame, by: list[str], index: str) -> DataFrame:
    """(by, first_index, last_index, n) of consecutive values of index."""
    w = Window.partitionBy(*by).orderBy(index)
    block = (F.col(index) - F.row_number().over(w)).alias("block")
    return rows.select(*by, index, block).groupBy(*by, "block").agg(F.min(index).alias("first_index"), F.max(index).alias("last_index"), F.count(F.lit(1)).alias("n")).drop("block")


def collapsed(rows: DataFrame, by: list[str], order: str, token: str, blank: object = None) -> DataFrame:
    """Rows whose token differs from the one before in their key; the first always stays, and
    of null tokens each does. Blank tokens go, but those beside them are told apart by them."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = rows.select("*", F.lag(token).over(w).alias("__before"))
    fresh = ~F.col(token).eqNullSafe(F.col("__before")) | F.col("__before").isNull()
    return marked.where(fresh if blank is None else fresh & ~F.col(token).eqNullSafe(F.lit(blank))).select(*rows.columns)


def backwards(by: list[str], order: list[str]) -> WindowSpec:
    """The rows of a key from its end. What follows a row comes before it here: a frame from a
    row to the end of its key is summed up anew for each row, one from the beginning is not."""
    return Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])


def next_known(rows: DataFrame, by: list[str], order: list[str], value: Column) -> Column:
    """The next value that is not null, the row's own aside."""
    return F.last(value, ignorenulls=True).over(backwards(by, order).rowsBetween(Window.unboundedPreceding, -1))


def bounds(value: str, by: list[str], order: list[str]) -> tuple[Column, Column]:
    """(greatest value so far, least value from here on)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.min(value).over(backwards(by, order).rowsBetween(Window.unboundedPreceding, 0))


def top(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)
