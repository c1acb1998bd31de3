"""Line-oriented sheets: stamped text in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions import timecodes

#: A stamp, and rows without one that are no text.
STAMP = r"\[\d+:\d{2}(?:[.:]\d{1,3})?\]"
NO_TEXT = r"^\[\w+:|^@"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parse(sheets: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """(key, line, start, original): a row for each of the stamps with which a line's stamps
    begin, up to the first text after a stamp, and one without start for a line without stamps.

    original is the line without any of its stamps, also those inside it; lines of stamps alone,
    blank ones, and lines without stamps that are tags or begin with @ are left out. A byte
    order mark is no text; a null sheet has no lines."""
    bare = F.replace(F.col(text), F.lit("\ufeff"), F.lit(""))
    raw = sheets.select(F.col(key).alias("key"), F.posexplode(F.split(bare, r"\r\n|\r|\n")).alias("pos", "row")).withColumn("line", F.col("pos") + 1)
    first = F.regexp_extract("row", rf"({STAMP}(?:\s*{STAMP})*)", 1)
    rows = raw.select("key", "line", "row", F.regexp_extract_all(first, F.lit(f"({STAMP})"), F.lit(1)).alias("stamps"), F.trim(F.regexp_replace("row", rf"{STAMP}", "")).alias("original"))
    rows = rows.where((F.col("original") != "") & ((F.size("stamps") > 0) | ~F.col("row").rlike(NO_TEXT)))
    return rows.select("key", "line", F.explode_outer("stamps").alias("s"), "original").select("key", "line", timecodes.seconds_of(F.col("s")).alias("start"), "original")


def export(lines: DataFrame, key: list[str], start: str, text: str, order: list[str]) -> DataFrame:
    """(key, sheet): stamped lines in order. A key is one sheet and is held as one value."""
    row = F.concat(timecodes.stamp(F.col(start)), F.col(text))
    packed = F.array_sort(F.collect_list(F.struct(*order, row.alias("row"))))
    return lines.groupBy(*key).agg(F.array_join(F.transform(packed, lambda x: x["row"]), "\n").alias("sheet"))
