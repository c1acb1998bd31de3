"""Queries over documents, pages, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.functions import texts
from chronotext.operators import sequences, time_joins
from chronotext.sources.sheets import table


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(texts.lines(F.col("text"))).alias("pos", "line"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


LINES_SQL = """l0 AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM documents),
 l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1)::BIGINT AS line_no FROM l0)"""


def passage_containment(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "benchmark").select("item_id", texts.words(F.lower("text")).alias("items"))
    docs = table(spark, sf, "documents").select("doc_id", texts.words(F.lower("text")).alias("items"))
    return time_joins.contained(parts, docs, 5, 0.7, texts.grams(F.col("items"), 5))


CONTAINMENT_SQL = r"""WITH p0 AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark), d0 AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
 p1 AS (SELECT item_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM p0), d1 AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d0),
 p AS (SELECT item_id, len(g) AS total, unnest(g) AS gram FROM p1), d AS (SELECT doc_id, unnest(g) AS gram FROM d1)
 SELECT item_id, doc_id, count(*) / any_value(total) AS share FROM p JOIN d USING (gram) GROUP BY item_id, doc_id HAVING count(*) / any_value(total) >= 0.7"""


def sheet_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("doc_id", "line_no", F.md5("line").alias("line_md5"))


def script_profile(spark: SparkSession, sf: str) -> DataFrame:
    count = lambda p: F.regexp_count(F.coalesce("text", F.lit("")), F.lit(p)).cast("long")
    return table(spark, sf, "documents").select("doc_id", count("[A-Za-z]").alias("latin"), count("[0-9]").alias("digits"), count(r"[^\x00-\x7F]").alias("other"))


def language_vote(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent language of a source; mixed where others make up 3 or more."""
    n = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("k"))
    v = n.groupBy("source").agg(F.min(F.struct((-F.col("k")).alias("minus"), "lang")).alias("b"), F.sum("k").alias("n"))
    return v.select("source", F.col("b.lang").alias("lang"), "n", (F.col("n") + F.col("b.minus") >= 3).alias("mixed"))


def meaningful_lines(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("line").rlike("[A-Za-z].*[A-Za-z]") & ~F.col("line").rlike(r"^[0-9 .,:;!?()\[\]-]+$")
    return _lines(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("meaningful"))


def ordered_distinct_lines(spark: SparkSession, sf: str) -> DataFrame:
    own = F.array_distinct(texts.lines(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", F.size(own).cast("long").alias("n"), F.md5(F.array_join(own, "\n")).alias("lines_md5"))


def reusable_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that occur more than once and are always followed by the same line."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    follow = _lines(spark, sf).withColumn("following", F.lead("line").over(w)).where("following is not null")
    g = follow.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("following").alias("a"), F.max("following").alias("b"))
    return g.where("n > 1 and a = b").select("line", F.col("a").alias("following"), "n")


def song_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.substring(F.sha2("url", 256), 1, 12).alias("key"))


def html_text(spark: SparkSession, sf: str) -> DataFrame:
    text = texts.plain_html(F.coalesce("html", F.lit("")))
    return table(spark, sf, "pages").select("page_id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_md5"))


def audit_upsert(spark: SparkSession, sf: str) -> DataFrame:
    fresh = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("status"))
    old = table(spark, sf, "documents").select("doc_id", F.lit("unseen").alias("status"))
    return time_joins.upsert(fresh, old, ["doc_id"])


def threshold_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """For each length: how many good and bad documents are at least that long."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("quality", "n_chars")
    steps = F.array(*[F.lit(x).cast("long") for x in (100, 300, 1000, 3000, 10000)])
    e = rows.select("quality", "n_chars", F.explode(steps).alias("threshold"))
    hit = F.col("n_chars") >= F.col("threshold")
    return e.groupBy("threshold").agg(F.count_if(hit & (F.col("quality") == 1)).alias("caught"), F.count_if(hit & (F.col("quality") == 0)).alias("false_alarms"), F.count(F.lit(1)).alias("n"))


def index_blocks(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where("role <> 'user'").select("conv_id", "turn")
    return sequences.index_blocks(c, ["conv_id"], "turn")


def bilingual_pairs(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    return c.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.md5("text").alias("asked"), F.md5("next_text").alias("answered"))


def argmax_collapse(spark: SparkSession, sf: str) -> DataFrame:
    top = F.array_position("embedding", F.array_max("embedding")).cast("long").alias("token")
    return sequences.collapsed(table(spark, sf, "embeddings").select("label", "vec_id", top), ["label"], "vec_id", "token")


def log_softmax(spark: SparkSession, sf: str) -> DataFrame:
    """The greatest log-probability; the greatest value is taken off first, so none overflows."""
    most = F.array_max("embedding").cast("double")
    total = F.log(F.aggregate(F.transform("embedding", lambda v: F.exp(v.cast("double") - most)), F.lit(0.0), lambda a, b: a + b))
    micro = F.floor(-total * 1e6 + 0.5) / 1e6
    return table(spark, sf, "embeddings").select("vec_id", micro.alias("best"))


QUERIES = {f.__name__: f for f in (passage_containment, sheet_lines, script_profile, language_vote, meaningful_lines, ordered_distinct_lines, reusable_lines, song_keys, html_text, audit_upsert, threshold_calibration, index_blocks, bilingual_pairs, argmax_collapse, log_softmax)}

SQL = {
    "passage_containment": CONTAINMENT_SQL,
    "sheet_lines": f"WITH {LINES_SQL} SELECT doc_id, line_no, md5(line) AS line_md5 FROM l",
    "script_profile": r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) AS latin, len(regexp_extract_all(coalesce(text, ''), '[0-9]')) AS digits, len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x7F]')) AS other FROM documents",
    "language_vote": "WITH n AS (SELECT source, lang, count(*) AS k FROM documents GROUP BY ALL) SELECT source, lang, n, n - k >= 3 AS mixed FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k DESC, lang NULLS FIRST) AS r, sum(k) OVER (PARTITION BY source)::BIGINT AS n FROM n) WHERE r = 1",
    "meaningful_lines": rf"WITH {LINES_SQL} SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(line, '[A-Za-z].*[A-Za-z]') AND NOT regexp_matches(line, '^[0-9 .,:;!?()\[\]-]+$')) AS meaningful FROM l GROUP BY doc_id",
    "ordered_distinct_lines": f"WITH {LINES_SQL}, f AS (SELECT doc_id, line, min(line_no) AS k FROM l GROUP BY ALL) SELECT d.doc_id, count(line) AS n, md5(coalesce(string_agg(line, chr(10) ORDER BY k), '')) AS lines_md5 FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id",
    "reusable_lines": f"WITH {LINES_SQL}, f AS (SELECT line, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS following FROM l) SELECT line, min(following) AS following, count(*) AS n FROM f WHERE following IS NOT NULL GROUP BY line HAVING count(*) > 1 AND count(DISTINCT following) = 1",
    "song_keys": "SELECT page_id, substr(sha256(url), 1, 12) AS key FROM pages",
    "html_text": r"WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ') AS t FROM pages) SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM t",
    "audit_upsert": "SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'unseen' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS status FROM documents d LEFT JOIN labels USING (doc_id)",
    "threshold_calibration": "SELECT threshold::BIGINT AS threshold, count(*) FILTER (n_chars >= threshold AND quality = 1) AS caught, count(*) FILTER (n_chars >= threshold AND quality = 0) AS false_alarms, count(*) AS n FROM documents JOIN labels USING (doc_id), (VALUES (100), (300), (1000), (3000), (10000)) AS v(threshold) GROUP BY 1",
    "index_blocks": "SELECT conv_id, min(turn) AS first_index, max(turn) AS last_index, count(*) AS n FROM (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations WHERE role <> 'user') GROUP BY conv_id, g",
    "bilingual_pairs": "SELECT conv_id, turn, md5(text) AS asked, md5(t) AS answered FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'",
    "argmax_collapse": "WITH a AS (SELECT label, vec_id, list_position(embedding, list_max(embedding))::BIGINT AS token FROM embeddings) SELECT label, vec_id, token FROM (SELECT *, lag(token) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM a) WHERE p IS NULL OR p <> token",
    "log_softmax": "SELECT vec_id, floor(-ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)))) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS best FROM embeddings",
}
