"""Queries that scan records, report, and join by bands and narrowing keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.functions import scripts
from chronotext.operators import robust, time_joins
from chronotext.plans import sheetwork, timed
from chronotext.plans.registry import Registry
from chronotext.sources.sheets import table

query = Registry()
E_SQL = f"e AS (SELECT user_id, event_type, event_id AS id, {timed.T_SQL} AS t, value FROM events)"


@query("""WITH j AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN left(props, 4) ELSE props END AS raw FROM events) SELECT event_id, CASE WHEN json_valid(raw) THEN (raw ->> '$.k')::BIGINT END AS k FROM j""")
def json_records(spark: SparkSession, sf: str) -> DataFrame:
    """A value of JSON records; null where the record is missing or cut off."""
    raw = F.when(F.col("event_id") % 5 == 0, F.left("props", F.lit(4))).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", F.from_json(raw, "k long")["k"].alias("k"))


@query(r"""WITH o AS (SELECT user_id, string_agg(CASE WHEN event_id % 3 = 0 THEN 'log: ' || event_type ELSE props END, chr(10) ORDER BY event_id) AS out FROM events GROUP BY 1),
 l AS (SELECT user_id, unnest(string_split(out, chr(10))) AS line FROM o) SELECT user_id, count(*) AS n, sum((line ->> '$.k')::BIGINT)::BIGINT AS total FROM l WHERE starts_with(line, '{') GROUP BY 1""")
def tagged_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records among a process's output: only lines that begin with a brace are read."""
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("log: "), "event_type")).otherwise(F.col("props"))
    lines = table(spark, sf, "events").select("user_id", line.alias("line")).where(F.col("line").startswith("{"))
    return lines.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.from_json("line", "k long")["k"]).alias("total"))


@query("SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT DISTINCT trim(' ' || c_custkey || ' ', ' ')::BIGINT AS k FROM customer WHERE c_acctbal < 0) ON o_custkey = k")
def listed_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose key stands in a list of keys, a line each, blanks trimmed."""
    lines = table(spark, sf, "customer").where("c_acctbal < 0").select(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" ")).alias("line"))
    keys = lines.select(F.trim("line").cast("long").alias("o_custkey")).distinct()
    return table(spark, sf, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""WITH u AS (SELECT doc_id, 'label' AS origin, 1 AS rank FROM labels UNION ALL SELECT doc_id, 'table', 2 FROM documents UNION ALL SELECT item_id, 'benchmark', 3 FROM benchmark)
 SELECT doc_id, arg_min(origin, rank) AS origin, count(*) AS n FROM u GROUP BY 1""")
def audit_union(spark: SparkSession, sf: str) -> DataFrame:
    """All sources of audits as one, the best source of each key first."""
    side = lambda name, key, origin, rank: table(spark, sf, name).select(F.col(key).alias("doc_id"), F.lit(origin).alias("origin"), F.lit(rank).alias("rank"))
    u = side("labels", "doc_id", "label", 1).unionByName(side("documents", "doc_id", "table", 2)).unionByName(side("benchmark", "item_id", "benchmark", 3))
    return u.groupBy("doc_id").agg(F.min_by("origin", "rank").alias("origin"), F.count(F.lit(1)).alias("n"))


@query("""SELECT l_suppkey, string_agg(l_orderkey, ',' ORDER BY l_orderkey) AS first_ids FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS k FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)) WHERE k <= 5 GROUP BY 1""")
def first_results(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier's first five orders."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey")
    d = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey").distinct().withColumn("k", F.row_number().over(w)).where("k <= 5")
    return d.groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_orderkey")), lambda x: x.cast("string")), ",").alias("first_ids"))


@query(f"""WITH {sheetwork.ROWS_SQL}, l AS (SELECT conv_id, turn, text, {sheetwork.LANG_SQL} AS lang, string_split(text, ' ')[-1] AS tail FROM rows),
 m AS (SELECT *, count(*) FILTER (lang = 'zh') OVER (PARTITION BY conv_id) * 1.0 / count(*) OVER (PARTITION BY conv_id) AS share FROM l)
 SELECT conv_id, turn, lang = 'en' AND len(regexp_extract_all(text, '{sheetwork.HAN_RE}')) >= 2 AND len(regexp_extract_all(text, '[A-Za-z]')) >= 2 AS suspect, length(tail) >= 6 AND {sheetwork.LANG_SQL.replace('text', 'tail')} <> lang AND share < 0.5 AS glued FROM m""")
def suspect_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that look like an original and its translation run together: two scripts with two
    letters each, or a long last word in another language than the row's."""
    l = sheetwork._rows(spark, sf).withColumn("lang", scripts.language(F.col("text"))).withColumn("tail", F.element_at(F.split("text", " "), -1))  # noqa: E741
    w = Window.partitionBy("conv_id")
    share = F.count_if(F.col("lang") == "zh").over(w) / F.count(F.lit(1)).over(w)
    many = lambda p: F.regexp_count("text", F.lit(p)) >= 2
    suspect = (F.col("lang") == "en") & many(sheetwork.HAN_RE) & many("[A-Za-z]")
    glued = (F.length("tail") >= 6) & (scripts.language(F.col("tail")) != F.col("lang")) & (share < 0.5)
    return l.select("conv_id", "turn", suspect.alias("suspect"), glued.alias("glued"))


@query("""WITH p AS (SELECT page_id, lower(regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1)) AS title, coalesce(html, '') AS html FROM pages)
 SELECT page_id, length(title) > 3 AND contains(regexp_replace(lower(html), '[^\\p{L}\\p{N}]', '', 'g'), regexp_replace(title, '[^\\p{L}\\p{N}]', '', 'g')) AND regexp_matches(html, '(?i)(video|image|img|nav)') AS hit FROM p""")
def search_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that hold a squashed title and one of the keywords."""
    html = F.coalesce("html", F.lit(""))
    p = table(spark, sf, "pages").select("page_id", html.alias("html"), F.lower(F.regexp_extract(html, "<title>([^<]*)</title>", 1)).alias("title"))
    hit = (F.length("title") > 3) & F.contains(scripts.squash(F.col("html")), F.regexp_replace("title", r"[^\p{L}\p{N}]", "")) & F.col("html").rlike("(?i)(video|image|img|nav)")
    return p.select("page_id", hit.alias("hit"))


@query(f"WITH {E_SQL}, r AS (SELECT * FROM e WHERE event_type = 'purchase'), l AS (SELECT * FROM e WHERE event_type = 'error') SELECT l.id, r.id AS covered_id FROM l JOIN r ON l.user_id = r.user_id AND r.t BETWEEN l.t - 43200000000 AND l.t + 54000000000")
def covering_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows (12 hours back, 15 ahead) and the rows that they cover. Rows meet by day: a
    window reaches into three at most, so only neighbouring days of a user are compared."""
    e, day = timed._events(spark, sf), 24 * 60 * timed.MINUTE
    part = lambda x: F.floor(x / day)
    a = e.where("event_type = 'error'").select("user_id", "id", "t", F.explode(F.sequence(part(F.col("t") - day / 2), part(F.col("t") + day * 5 / 8))).alias("day"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("id").alias("covered_id"), F.col("t").alias("u"), part(F.col("t")).alias("day"))
    inside = F.col("u").between(F.col("t") - day // 2, F.col("t") + day * 5 // 8)
    return a.join(b, ["user_id", "day"]).where(inside).select("id", "covered_id")


@query("""WITH p AS (SELECT p_partkey AS id, p_brand AS artist, p_type AS album, floor(p_retailprice * 100 + 0.5)::BIGINT AS d FROM part), q AS (SELECT c_custkey AS qid, 'Brand#' || (c_custkey % 5 + 1) || (c_custkey % 3 + 1) AS artist, c_custkey AS k FROM customer),
 c AS (SELECT qid, k, p.*, abs(d - 100000 - k) AS off FROM q JOIN p USING (artist)), f AS (SELECT qid, arg_min(album, (off, id)) AS album FROM c GROUP BY 1)
 SELECT c.qid, f.album, arg_min(c.id, (c.off, c.id)) AS id, count(*) AS n FROM c JOIN f ON c.qid = f.qid AND c.album = f.album GROUP BY ALL""")
def narrowed_match(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates narrowed step by step: by artist, then by the album of the nearest of them,
    then to the nearest in duration. That is the nearest of the artist, so rows are sorted by
    artist and duration and never meet in pairs; the album's rows are counted beside."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"), F.floor(F.col("p_retailprice") * 100 + 0.5).alias("t"))
    k = F.col("c_custkey")
    q = table(spark, sf, "customer").select(k.alias("id"), F.concat(F.lit("Brand#"), (k % 5 + 1).cast("string"), (k % 3 + 1).cast("string")).alias("artist"), (k + 100000).alias("t"))
    best = time_joins.nearest(q, p, ["artist"], None, by_id=True).select(F.col("id").alias("qid"), F.col("match_id").alias("id")).where("id is not null")
    counts = p.groupBy("artist", "album").agg(F.count(F.lit(1)).alias("n"))
    return best.join(p.select("id", "artist", "album"), "id").join(counts, ["artist", "album"]).select("qid", "album", "id", "n")


@query("""WITH l AS (SELECT l_suppkey, l_quantity AS q, l_extendedprice / l_quantity AS pace FROM lineitem WHERE l_quantity >= 6) SELECT l_suppkey, count(*) AS n, floor(median(pace) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS pace FROM l GROUP BY 1""")
def usual_pace(spark: SparkSession, sf: str) -> DataFrame:
    """The median price per unit over lines with six units or more."""
    l = table(spark, sf, "lineitem").where("l_quantity >= 6").select("l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("pace"))  # noqa: E741
    q = robust.quantiles(l, ["l_suppkey"], "pace", {"middle": 0.5})
    return q.select("l_suppkey", "n", (F.floor(F.col("middle") * 1e6 + 0.5) / 1e6).alias("pace"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders), d AS (SELECT o_custkey FROM o GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') = count(*))
 SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM o ANTI JOIN d USING (o_custkey)) WHERE k <= 3""")
def pending_work(spark: SparkSession, sf: str) -> DataFrame:
    """What is to be done again: of keys that aren't finished the three largest rows."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    done = o.groupBy("o_custkey").agg(F.bool_and(F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))).alias("done")).where("done").select("o_custkey")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.join(done, "o_custkey", "left_anti").withColumn("k", F.row_number().over(w)).where("k <= 3").select("o_custkey", "o_orderkey")


QUERIES, SQL = query.queries, query.sql
