"""Queries on rows with stamps inside, footers of readings, and symbols placed on frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.functions import texts, timecodes
from chronotext.operators import alignment, framewise
from chronotext.plans.registry import Registry
from chronotext.sources.sheets import table

query = Registry()

_STAMP = "printf('[%02d:%02d:%02d]', ({0}) // 6000, ({0}) // 100 % 60, ({0}) % 100)"
_WORDS = r"w AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS own FROM conversations)"
_TAGGED = _WORDS + f""", g AS (SELECT conv_id, turn, own, len(list_filter(own, lambda x: regexp_matches(x, '[\\[\\]]'))) > 0 AS refused,
 array_to_string(list_transform(own, lambda x, i: {_STAMP.format("(i - 1) * 37")} || x), '') || {_STAMP.format("len(own) * 37")} AS row FROM w)"""


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, own, row): each turn's words, 0.37 seconds each, and its tagged row."""
    own = table(spark, sf, "conversations").select("conv_id", "turn", texts.words(F.coalesce("text", F.lit(""))).alias("own"))
    parts = F.transform("own", lambda x, i: F.struct(x.alias("text"), (i * 37 / 100).alias("start")))
    return own.withColumn("row", timecodes.tagged(parts, F.size("own") * 37 / 100))


@query(f"""WITH {_TAGGED}, p AS (SELECT conv_id, turn, unnest(own) AS text, generate_subscripts(own, 1) AS i FROM g WHERE NOT refused)
 SELECT conv_id, turn, (i - 1)::INT AS part, text, (i - 1) * 37 / 100.0::DOUBLE AS start, i * 37 / 100.0::DOUBLE AS "end" FROM p""")
def timed_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of tagged rows with their times, read back from the rows."""
    parts = F.posexplode(timecodes.timed_parts(F.col("row")))
    found = _rows(spark, sf).select("conv_id", "turn", parts.alias("part", "p"))
    tidy = lambda c: timecodes.half_up(F.col(c))
    return found.select("conv_id", "turn", "part", "p.text", tidy("p.start").alias("start"), tidy("p.end").alias("end"))


@query(f"""WITH {_TAGGED} SELECT conv_id, turn, len(own)::BIGINT AS n_parts, CASE WHEN NOT refused THEN md5(row) END AS row_md5, NOT refused AS same FROM g""")
def tagged_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each turn's tagged row reads back to the same pieces; rows whose text would be
    taken for stamps are refused (no row, not the same)."""
    back = F.transform(timecodes.timed_parts(F.col("row")), lambda p: p["text"])
    same = F.coalesce(back == F.col("own"), F.lit(False))
    return _rows(spark, sf).select("conv_id", "turn", F.size("own").cast("long").alias("n_parts"), F.md5("row").alias("row_md5"), same.alias("same"))


@query(rf"""WITH {_WORDS}, u AS (SELECT conv_id, turn, unnest(own) AS base, generate_subscripts(own, 1) AS i FROM w),
 f AS (SELECT conv_id, base, min((turn, i)) AS first FROM u WHERE NOT contains(base, ',') GROUP BY ALL)
 SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY first)::BIGINT AS n, base, reverse(base) AS reading, ((first[2] - 1) * 37 / 100.0)::DOUBLE AS start FROM f""")
def reading_footer(spark: SparkSession, sf: str) -> DataFrame:
    """A footer row for each base, numbered by its first place, read back into its fields. A
    base with the field separator gets none. Rows of one conversation are numbered together."""
    own = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(texts.words(F.coalesce("text", F.lit("")))).alias("i", "base"))
    first = own.where(~F.contains("base", F.lit(","))).groupBy("conv_id", "base").agg(F.min(F.struct("turn", "i")).alias("first"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("first"))
    row = F.concat(F.lit("@Ruby"), number, F.lit("="), F.concat_ws(",", "base", F.reverse("base"), timecodes.stamp(F.col("first.i") * 37 / 100, ":")))
    field = lambda i: F.regexp_extract("row", r"(?s)^@Ruby(\d+)=([^,]*),([^,]*)(?:,(.*))?$", i)
    footer = first.select("conv_id", row.alias("row"))
    return footer.select("conv_id", field(1).cast("long").alias("n"), field(2).alias("base"), field(3).alias("reading"), timecodes.half_up(timecodes.seconds_of(field(4))).alias("start"))


@query()
def ctc_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """The frames in which three symbols begin: a vector's values are taken as the scores of 8
    symbols a frame, the first of them the blank, and symbol k holds no frame before the k-th."""
    wanted = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: (F.floor(F.col("vec_id") / F.pow(F.lit(7), k)) % 7 + 1).cast("int"))
    frames = F.floor(F.size("embedding") / 8).cast("int")
    low, high = F.array(*map(F.lit, range(3))), F.array_repeat(frames - 1, 3)
    starts = framewise.placed(8)(F.col("embedding"), wanted, low, high)
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(wanted, ",").alias("symbols"), F.array_join(starts, ",").alias("starts"))


@query()
def monotone_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The words that a turn and the next one share in order, by a pairing of least cost."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = table(spark, sf, "conversations").select("conv_id", "turn", texts.words(F.lower(F.coalesce("text", F.lit("")))).alias("own"))
    both = own.withColumn("after", F.lead("own").over(w)).where("after is not null")
    found = both.select("conv_id", "turn", "own", alignment.columns()["pairs_in_order"]("own", "after").alias("p"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("p") / 2).cast("int") - 1), lambda k: F.struct(F.get("p", k * 2).alias("a"), F.get("p", k * 2 + 1).alias("b"))))
    return found.where(F.size("p") > 0).select("conv_id", "turn", "own", pairs.alias("x")).select("conv_id", "turn", F.col("x.a").alias("place"), F.col("x.b").alias("next_place"), F.get("own", F.col("x.a")).alias("word"))


QUERIES, SQL = query.queries, query.sql
