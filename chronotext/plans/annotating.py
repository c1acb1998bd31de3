"""Queries that put readings on timed lines. A turn's words are a line's, 0.37 seconds each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.functions import marks, texts, trees
from chronotext.operators import annotation
from chronotext.plans.auditing import LETTERS, SIGNS, SOUNDS
from chronotext.plans.registry import Registry
from chronotext.sources.sheets import table

query = Registry()

_WORDS_SQL = r"w AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS own FROM conversations)"


def _words(spark: SparkSession, sf: str, *by: str) -> DataFrame:
    """by: what the texts are dealt by, which for them is less than for all that is made of them."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return (turns.repartition(*by) if by else turns).select("conv_id", "turn", texts.words(F.lower(F.coalesce("text", F.lit("")))).alias("own"))


@query(f"""WITH {_WORDS_SQL}, s AS (SELECT conv_id, turn, array_to_string(list_transform(own, lambda x, i: CASE i % 3 WHEN 1 THEN translate(left(x, 2), '{LETTERS}', '{SIGNS}') || '(' || translate(x, '{LETTERS}', '{SOUNDS}') || ')' WHEN 2 THEN '｜' || x || '（' || translate(x, '{LETTERS}', '{SOUNDS}') || '）' ELSE x END), ' ') AS text FROM w),
 m AS (SELECT conv_id, turn, regexp_replace(text, '(?:｜([^｜(（)）]+)|([㐀-鿿々○×]+))[(（]([a-zA-Zぁ-ヿ]+)[)）]', '{{\\1\\2|\\3}}', 'g') AS marked FROM s)
 SELECT conv_id, turn, len(regexp_extract_all(marked, '\\{{[^{{}}|]+\\|[^{{}}]*\\}}')) AS n, md5(marked) AS marked, md5(regexp_replace(marked, '\\{{([^{{}}|]+)\\|([^{{}}]*)\\}}', '\\1', 'g')) AS bare, md5(regexp_replace(marked, '\\{{([^{{}}|]+)\\|([^{{}}]*)\\}}', '\\2', 'g')) AS read FROM m""")
def bracket_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Readings in brackets as marks, and the text with and without them."""
    sound = lambda x: F.translate(x, LETTERS, SOUNDS)
    one = lambda x, i: (
        F.when(i % 3 == 0, F.concat(F.translate(F.left(x, F.lit(2)), LETTERS, SIGNS), F.lit("("), sound(x), F.lit(")"))).when(i % 3 == 1, F.concat(F.lit("｜"), x, F.lit("（"), sound(x), F.lit("）"))).otherwise(x))
    s = _words(spark, sf).select("conv_id", "turn", marks.bracketed(F.array_join(F.transform("own", one), " ")).alias("m"))
    return s.select("conv_id", "turn", F.regexp_count("m", F.lit(marks.MARK)).cast("long").alias("n"), F.md5("m").alias("marked"), F.md5(marks.bare(F.col("m"))).alias("bare"), F.md5(marks.read(F.col("m"))).alias("read"))


@query(f"""WITH {_WORDS_SQL}, e AS (SELECT conv_id, turn, unnest(own) AS x, generate_subscripts(own, 1) - 1 AS n, unnest(list_prepend('', own[:len(own) - 1])) AS x0 FROM w),
 i AS (SELECT conv_id, turn, n, length(x) % 5 = 2 AND (length(x0) % 5 = 1 OR turn % 7 = 3) AS more, length(x) % 5 = 1 AS first, length(x) % 5 > 2 AS sung, x FROM e),
 j AS (SELECT *, CASE WHEN more THEN '' ELSE x END AS orig, more AND NOT coalesce(lag(more OR first) OVER o, false) AS orphan, greatest(sum((first OR sung)::INT) OVER o, 1) AS k FROM i WINDOW o AS (PARTITION BY conv_id, turn ORDER BY n)),
 g AS (SELECT conv_id, turn, k, string_agg(orig, '' ORDER BY n) AS text, min(n) FILTER (first OR sung OR more) AS a, max(n) FILTER (first OR sung OR more) AS b, string_agg(reverse(x), '+' ORDER BY n) FILTER (first OR more) AS ruby, bool_or(orphan) AS orphan, bool_or(first OR sung) AS has_sung FROM j GROUP BY ALL),
 l AS (SELECT conv_id, turn, string_agg(text, '' ORDER BY k) AS full_text, string_agg(text || ':' || a || '-' || b || ':' || coalesce(ruby, ''), ' ' ORDER BY k) AS shape, count(*) AS n, bool_or(orphan) AS orphan, bool_or(has_sung) AS has_sung FROM g GROUP BY ALL),
 p AS (SELECT *, CASE WHEN orphan THEN 'readings go on after none' WHEN NOT has_sung THEN 'nothing is sung' WHEN turn % 5 = 4 AND full_text <> 'x' THEN 'the text has changed' END AS problem FROM l)
 SELECT conv_id, turn, problem, CASE WHEN problem IS NULL THEN n END AS n_words, CASE WHEN problem IS NULL THEN md5(shape) END AS shape FROM p""")
def lines_from_units(spark: SparkSession, sf: str) -> DataFrame:
    """Lines built from units with readings, sung ones and others; some can't be."""
    e = _words(spark, sf).select("conv_id", "turn", F.posexplode("own").alias("n", "x"), F.col("own").alias("all"))
    size = F.length("x") % 5
    before = F.length(F.get("all", F.col("n") - 1)) % 5
    more = (size == 2) & (F.coalesce(before == 1, F.lit(False)) | (F.col("turn") % 7 == 3))
    units = e.select("conv_id", "turn", "n", (size > 2).alias("sung"), F.when(more, "").otherwise(F.col("x")).alias("orig"), F.when(more | (size == 1), F.reverse("x")).alias("reading"), F.col("n").alias("start"), F.col("n").alias("end"), F.when(F.col("turn") % 5 == 4, "x").alias("expected"))
    got = annotation.built(units, ["conv_id", "turn"])
    ruby = lambda w: F.coalesce(F.array_join(F.transform(F.get(w["syllables"], F.lit(0))["ruby"], lambda r: r["text"]), "+"), F.lit(""))
    shape = F.array_join(F.transform("line.words", lambda w: F.concat(w["text"], F.lit(":"), w["startTime"].cast("int"), F.lit("-"), w["endTime"].cast("int"), F.lit(":"), ruby(w))), " ")
    return got.select("conv_id", "turn", "problem", F.size("line.words").cast("long").alias("n_words"), F.md5(shape).alias("shape"))


def _sung(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(lines, rules): a conversation's turns one after another, a minute each, and as rules every
    seventh stretch of two letters within its words or across them, some for a time only."""
    own = _words(spark, sf, "conv_id")
    at = lambda i: F.col("turn") * 60.0 + i * 0.37
    word = lambda x, i: F.struct(x.alias("text"), at(i).alias("startTime"), at(i + 1).alias("endTime"), F.lit(None).alias("syllables"))
    line = F.struct(F.array_join("own", "").alias("fullText"), F.lit(None).alias("translation"), at(F.lit(0)).alias("startTime"), at(F.size("own")).alias("endTime"), F.transform("own", word).alias("words"))
    lines = own.select("conv_id", F.col("turn").alias("place"), line.cast(trees.LINE).alias("line"))
    text = F.array_join("own", "")
    # one column, as inside the stretches the text would be put together anew for each
    stretch = F.when(F.length("text") >= 7, F.transform(F.sequence(F.lit(1), F.length("text") - 6, F.lit(7)), lambda i: F.substring("text", i, 2 + i % 3)))
    r = own.select("conv_id", "turn", text.alias("text")).select("conv_id", "turn", F.posexplode(stretch).alias("n", "base")).withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "n")))
    some = F.col("n") % 2 == 1
    return lines, r.select("conv_id", "rank", "base", F.upper("base").alias("reading"), F.when(some, F.col("turn") * 60.0).alias("begin"), F.when(some, F.col("turn") * 60.0 + 4).alias("until"))


@query()
def annotated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with the readings that a conversation's rules give them."""
    done = annotation.annotated(*_sung(spark, sf), ["conv_id"])
    read = F.filter(F.flatten(F.filter(F.transform("line.words", lambda w: w["syllables"]), lambda s: s.isNotNull())), lambda s: s["ruby"].isNotNull())
    return done.select("conv_id", "place", F.size("line.words").alias("n_words"), F.size(read).alias("n_readings"), F.md5(F.to_json("line")).alias("line_md5"))


QUERIES, SQL = query.queries, query.sql
