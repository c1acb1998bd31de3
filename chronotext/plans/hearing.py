"""Queries on recordings: offsets, shifts, tokens, and what was heard against what is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.functions import scripts, texts
from chronotext.operators import listening, robust, sequences, signals
from chronotext.plans import timed
from chronotext.plans.registry import Registry
from chronotext.sources.sheets import table

query = Registry()


@query("""WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, coalesce(value, 0) AS value FROM events),
 b AS (SELECT user_id, place - 2 - user_id % 9 AS place, value + (place * 7919 % 13) AS value FROM o WHERE place >= 2 + user_id % 9),
 s AS (SELECT 1 AS side, * FROM o UNION ALL SELECT 2, * FROM b), g AS (SELECT *, count(*) OVER w AS n, coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0) AS z FROM s WINDOW w AS (PARTITION BY side, user_id)),
 c AS (SELECT x.user_id, x.place - y.place AS lag, round(sum(x.z * y.z) / any_value(least(x.n, y.n)), 9) AS score FROM g x JOIN g y ON x.user_id = y.user_id AND x.side = 1 AND y.side = 2 AND abs(x.place - y.place) <= 40 GROUP BY ALL)
 SELECT user_id, arg_max(lag, (score, -lag)) AS lag, round(max(score), 6) AS score FROM c GROUP BY 1""")
def recording_offset(spark: SparkSession, sf: str) -> DataFrame:
    """How many events later a user's signal runs than a cut and noisy copy of it."""
    place = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    o = table(spark, sf, "events").select("user_id", place.alias("place"), F.coalesce("value", F.lit(0)).cast("double").alias("value"))
    cut = 2 + F.col("user_id") % 9
    copy = o.where(F.col("place") >= cut).select("user_id", (F.col("place") - cut).alias("place"), (F.col("value") + F.col("place") * 7919 % 13).alias("value"))
    return signals.offset(o, copy, ["user_id"], 40).select("user_id", "lag", F.round("score", 6).alias("score"))


def _song(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(lines, heard) of each conversation: its lines, three seconds each, and those lines as they
    were heard: some words turned round, every fifth line left out, some lines of the one before
    and of the next conversation between."""
    own = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(texts.lines(F.col("text"))).alias("k", "text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "k")).cast("long")
    rows = own.select("conv_id", place.alias("place"), "text")
    at = F.col("place") * 3.0
    lines = rows.select("conv_id", "place", F.when((F.col("conv_id") % 7 != 3) | (F.col("place") % 4 != 2), at).alias("start"), scripts.squash(scripts.hiragana(F.col("text"))).alias("sound"))
    turned = F.transform(texts.words(F.col("text")), lambda x, i: F.when(i % 6 == 4, F.reverse(x)).otherwise(x))
    other = rows.where("place % 3 = 0").select((F.col("conv_id") - 1).alias("conv_id"), "place", F.col("text").alias("strange"))
    heard = rows.withColumn("said", F.array_join(turned, "")).join(other, ["conv_id", "place"], "left").where("place % 5 <> 1")
    words = F.concat(F.col("said"), F.coalesce("strange", F.lit("")), F.col("said"))
    return lines, heard.select("conv_id", F.col("place").alias("n"), at.alias("start"), (at + 6).alias("end"), scripts.squash(words).alias("sound"))


@query()
def unheard_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of which less than half was heard."""
    return listening.unheard(*_song(spark, sf), ["conv_id"]).withColumn("share", F.round("share", 6))


@query()
def unwritten_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases that were heard and stand in no line."""
    return listening.unwritten(*_song(spark, sf), ["conv_id"], 6)


@query("""WITH e AS (SELECT user_id, event_id AS id, floor(value * 100 + 0.5)::BIGINT AS t FROM events WHERE value IS NOT NULL),
 n AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near FROM e),
 c AS (SELECT user_id, arg_max(t, (near, -id)) AS centre FROM n GROUP BY 1), u AS (SELECT e.user_id, median(t)::DOUBLE AS usual FROM e JOIN c USING (user_id) WHERE abs(t - centre) <= 100 GROUP BY 1)
 SELECT e.user_id, usual, count(*) AS n, min(id) AS first_id FROM e JOIN u USING (user_id) WHERE abs(t - usual) <= 200 GROUP BY ALL HAVING count(*) >= 3""")
def usual_shift(spark: SparkSession, sf: str) -> DataFrame:
    """The shift that most of a user's values share: the median around the one with the most
    others near it, and how many lie near that median, the first of them named."""
    e = timed.near_values(spark, sf)
    centre = e.groupBy("user_id").agg(F.max(F.struct("n", (-F.col("id")).alias("back"), "t"))["t"].alias("centre"))
    around = e.join(centre, "user_id").where(F.abs(F.col("t") - F.col("centre")) <= 100)
    usual = robust.quantiles(around, ["user_id"], "t", {"usual": 0.5}).select("user_id", F.col("usual").cast("double").alias("usual"))
    alike = e.drop("n").join(usual, "user_id").where(F.abs(F.col("t") - F.col("usual")) <= 200)
    return alike.groupBy("user_id", "usual").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n >= 3")


@query("""WITH t AS (SELECT label, vec_id, list_position(embedding, list_max(embedding))::BIGINT % 5 AS token FROM embeddings), l AS (SELECT *, lag(token) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM t)
 SELECT label, vec_id, token FROM l WHERE token IS DISTINCT FROM before AND token <> 0""")
def heard_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """What frames say: repeated tokens once, unless a blank (0) parts them, and no blanks."""
    token = (F.array_position("embedding", F.array_max("embedding")).cast("long") % 5).alias("token")
    return sequences.collapsed(table(spark, sf, "embeddings").select("label", "vec_id", token), ["label"], "vec_id", "token", 0)


QUERIES, SQL = query.queries, query.sql
