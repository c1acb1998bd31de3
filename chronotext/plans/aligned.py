"""Queries over votes, gates, credits, and sequences held against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.functions import texts
from chronotext.operators import alignment, one_to_one, time_joins
from chronotext.plans import timed
from chronotext.sources.sheets import table

MINUTE = timed.MINUTE
CREDIT = r"(?i)^(by|author|source|license|copyright|contact|published)\b"


def band_first_match(spark: SparkSession, sf: str) -> DataFrame:
    return one_to_one.first_in_band(*timed._sides(spark, sf), ["user_id"], 600 * MINUTE)


def greedy_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return one_to_one.greedy_nearest(*timed._sides(spark, sf), ["user_id"], 600 * MINUTE)


def twin_drift(spark: SparkSession, sf: str) -> DataFrame:
    """The n-th purchase of a user beside the n-th other event, where they are over a day apart."""
    buy = F.col("event_type") == "purchase"
    placed = timed._events(spark, sf).withColumn("buy", buy).withColumn("place", F.row_number().over(Window.partitionBy("user_id", "buy").orderBy("t", "id")))
    twins = placed.groupBy("user_id", "place").agg(F.max(F.when(F.col("buy"), F.col("t"))).alias("a"), F.max(F.when(~F.col("buy"), F.col("t"))).alias("b"))
    return twins.where(F.abs(F.col("a") - F.col("b")) > 1440 * MINUTE).select("user_id", "place", (F.col("a") - F.col("b")).alias("drift"))


def vote_units(spark: SparkSession, sf: str) -> DataFrame:
    """Votes of a user's day: agreed if two or more lie within 10, alone, or split."""
    day = F.floor(F.col("t") / F.lit(1440 * MINUTE))
    cents = F.floor(F.col("value") * 100 + 0.5)
    g = timed._events(spark, sf).groupBy("user_id", day.alias("day")).agg(F.count("value").alias("votes"), (F.max(cents) - F.min(cents)).alias("span"))
    return g.select("user_id", "day", "votes", "span", F.when((F.col("votes") >= 2) & (F.col("span") <= 1000), "agreed").when(F.col("votes") <= 1, "alone").otherwise("split").alias("vote"))


def rewrite_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that may be rewritten: no line over 30 days late, few over 10 days from the first."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.datediff("l_shipdate", F.lit("1992-01-01")).alias("d"))
    first = F.min("d").over(Window.partitionBy("l_orderkey"))
    g = lines.withColumn("off", F.col("d") - first).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("off") > 10).alias("late"), F.max("off").cast("long").alias("most"))
    ok = (F.col("most") <= 30) & (F.col("late") <= F.greatest(F.lit(2.0), F.col("n") * 0.1))
    return g.select("l_orderkey", "n", "late", "most", F.when(ok, "go").otherwise("hold").alias("gate"))


def page_order(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders in the order of a review page: urgent first, then large, then by key."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


def flag_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The state of each flag: how often it was set, and the newest value."""
    e = timed._events(spark, sf).groupBy("user_id", "event_type")
    return e.agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("newest"), F.max_by("value", F.struct("t", "id")).alias("value"))


def credit_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that name an author, a source or rights, per document."""
    lines = table(spark, sf, "documents").select("doc_id", F.filter(texts.lines(F.col("text")), lambda x: x.rlike(CREDIT)).alias("own"))
    return lines.where(F.size("own") > 0).select("doc_id", F.size("own").cast("long").alias("n"), F.md5(F.array_join("own", "\n")).alias("lines_md5"))


def page_pieces(spark: SparkSession, sf: str) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    count = lambda p: F.regexp_count(html, F.lit(p)).cast("long")
    return table(spark, sf, "pages").select("page_id", count("<p[ >]").alias("paragraphs"), count("<a[ >]").alias("links"), count("</[a-z0-9]+>").alias("closed"))


def blank_probability(spark: SparkSession, sf: str) -> DataFrame:
    most = F.array_max("embedding").cast("double")
    x = F.transform("embedding", lambda v: F.exp(v.cast("double") - most))
    share = F.element_at(x, 1) / F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return table(spark, sf, "embeddings").select("vec_id", (F.floor(share * 1e6 + 0.5) / 1e6).alias("blank"))


def _asked_and_answered(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", texts.words(F.lower(F.coalesce("text", F.lit("")))).alias("own"))
    return c.withColumn("after", F.lead("own").over(w)).where("after is not null")


def monotone_pairing(spark: SparkSession, sf: str) -> DataFrame:
    """The cost of pairing a turn's words with the next turn's, in order."""
    cost = alignment.columns()["pairing_cost"]
    return _asked_and_answered(spark, sf).select("conv_id", "turn", cost("own", "after").alias("cost"))


def substring_distance(spark: SparkSession, sf: str) -> DataFrame:
    """How far a turn's longest word (the first of them by code points) is from the nearest
    stretch of the next turn."""
    word = F.element_at(F.array_sort(F.transform("own", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), 1)["x"]
    rows = _asked_and_answered(spark, sf).where(F.size("own") > 0)
    far = alignment.columns()["distance_within"]
    return rows.select("conv_id", "turn", F.split(word, "").alias("a"), F.split(F.array_join("after", " "), "").alias("b")).select("conv_id", "turn", far("a", "b").alias("distance"))


def ordered_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of a benchmark passage's words that a document has in order, for the pairs that
    share at least 0.3 of the passage's five-word grams."""
    parts = table(spark, sf, "benchmark").select("item_id", texts.words(F.lower("text")).alias("items"))
    docs = table(spark, sf, "documents").select("doc_id", texts.words(F.lower("text")).alias("items"))
    near = time_joins.contained(parts, docs, 5, 0.3, texts.grams(F.col("items"), 5)).select("item_id", "doc_id")
    both = near.join(parts.withColumnRenamed("items", "a"), "item_id").join(docs.withColumnRenamed("items", "b"), "doc_id")
    return both.select("item_id", "doc_id", alignment.columns()["covered_in_order"]("a", "b").alias("share"))


QUERIES = {f.__name__: f for f in (band_first_match, greedy_nearest, twin_drift, vote_units, rewrite_gate, page_order, flag_fold, credit_rows, page_pieces, blank_probability, monotone_pairing, substring_distance, ordered_coverage)}

_EVENTS = f"WITH {timed.SIDES_SQL}"

SQL = {
    "band_first_match": _EVENTS + """ SELECT user_id, id, t, match_id, match_t FROM (SELECT l.user_id, l.id, l.t, r.id AS match_id, r.t AS match_t,
 row_number() OVER (PARTITION BY l.id ORDER BY r.t NULLS LAST, r.id) AS k FROM l LEFT JOIN r ON l.user_id = r.user_id AND abs(l.t - r.t) <= 36000000000) WHERE k = 1""",
    "twin_drift": _EVENTS + """, p AS (SELECT *, event_type = 'purchase' AS buy, row_number() OVER (PARTITION BY user_id, event_type = 'purchase' ORDER BY t, id) AS place FROM e)
 SELECT a.user_id, a.place::INT AS place, a.t - b.t AS drift FROM p a JOIN p b ON a.user_id = b.user_id AND a.place = b.place AND a.buy AND NOT b.buy WHERE abs(a.t - b.t) > 86400000000""",
    "vote_units": _EVENTS + """, g AS (SELECT user_id, floor(t / 86400000000)::BIGINT AS day, count(value) AS votes, max(floor(value * 100 + 0.5)::BIGINT) - min(floor(value * 100 + 0.5)::BIGINT) AS span FROM e GROUP BY ALL)
 SELECT *, CASE WHEN votes >= 2 AND span <= 1000 THEN 'agreed' WHEN votes <= 1 THEN 'alone' ELSE 'split' END AS vote FROM g""",
    "rewrite_gate": """WITH l AS (SELECT l_orderkey, date_diff('day', min(l_shipdate) OVER (PARTITION BY l_orderkey)::DATE, l_shipdate::DATE) AS off FROM lineitem),
 g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (off > 10) AS late, max(off)::BIGINT AS most FROM l GROUP BY 1)
 SELECT *, CASE WHEN most <= 30 AND late <= greatest(2.0, n * 0.1) THEN 'go' ELSE 'hold' END AS gate FROM g""",
    "page_order": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders",
    "flag_fold": _EVENTS + " SELECT user_id, event_type, count(*) AS n, max(t) AS newest, arg_max(value, (t, id)) AS value FROM e GROUP BY ALL",
    "credit_rows": r"""WITH l0 AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND regexp_matches(x, '(?i)^(by|author|source|license|copyright|contact|published)\b')) AS own FROM documents)
 SELECT doc_id, len(own) AS n, md5(array_to_string(own, chr(10))) AS lines_md5 FROM l0 WHERE len(own) > 0""",
    "page_pieces": "SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '<p[ >]')) AS paragraphs, len(regexp_extract_all(coalesce(html, ''), '<a[ >]')) AS links, len(regexp_extract_all(coalesce(html, ''), '</[a-z0-9]+>')) AS closed FROM pages",
    "blank_probability": "SELECT vec_id, floor(exp(embedding[1]::DOUBLE - list_max(embedding)::DOUBLE) / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE))) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS blank FROM embeddings",
}
