"""Queries that place units in time: shifts, spreads, bounds, gates. A user's events are the
units of a sheet, ordered by time; ``value`` is a unit's start in seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.functions import scripts, timecodes
from chronotext.operators import robust, sequences, time_joins
from chronotext.plans import timed
from chronotext.plans.registry import Registry
from chronotext.sources.sheets import table

query = Registry()
E_SQL = f"e AS (SELECT user_id, event_type, event_id AS id, {timed.T_SQL} AS t, value FROM events)"
W_SQL = "(PARTITION BY user_id ORDER BY t, id)"
cents = lambda x: F.floor(x * 100 + 0.5) / 100.0
micro = lambda x: F.floor(x * 1e6 + 0.5) / 1e6
in_time = lambda: Window.partitionBy("user_id").orderBy("t", "id")
bought = lambda: F.col("event_type") == "purchase"


@query(f"""WITH {E_SQL} SELECT id, CASE WHEN ok THEN 'moved' ELSE 'refused' END AS status, CASE WHEN ok THEN greatest(0.0::DOUBLE, floor((value + 0.25::DOUBLE + d) * 100 + 0.5) / 100.0) ELSE value END AS start
 FROM (SELECT *, coalesce(event_type = wanted, true) AS ok FROM (SELECT e.*, CASE WHEN t % 3 = 0 THEN NULL WHEN t % 3 = 1 THEN 'click' ELSE 'view' END AS wanted, (id % 7 - 3)::DOUBLE / 10 AS d FROM e))""")
def line_edits(spark: SparkSession, sf: str) -> DataFrame:
    """A common and a line's own shift, never below 0; an edit that names another text than
    the line's is refused and leaves it where it is."""
    e = timed._events(spark, sf)
    wanted = F.when(F.col("t") % 3 == 0, None).when(F.col("t") % 3 == 1, "click").otherwise("view")
    edits = e.select("id", wanted.alias("wanted"), ((F.col("id") % 7 - 3).cast("double") / 10).alias("d"))
    ok = F.coalesce(F.col("event_type") == F.col("wanted"), F.lit(True))
    moved = F.greatest(F.lit(0.0), cents(F.col("value") + 0.25 + F.col("d")))
    return e.join(edits, "id").select("id", F.when(ok, "moved").otherwise("refused").alias("status"), F.when(ok, moved).otherwise(F.col("value")).alias("start"))


@query(f"WITH {E_SQL} SELECT id, greatest(least(value, high), low) AS start FROM (SELECT *, coalesce(lag(value) OVER w, 0.0::DOUBLE) AS low, coalesce(lead(value) OVER w, 1e9::DOUBLE) AS high FROM e WINDOW w AS {W_SQL})")
def clamp_between(spark: SparkSession, sf: str) -> DataFrame:
    """Each start brought below the next one's and then above the previous one's."""
    e = timed._events(spark, sf).withColumn("low", F.coalesce(F.lag("value").over(in_time()), F.lit(0.0))).withColumn("high", F.coalesce(F.lead("value").over(in_time()), F.lit(1e9)))
    return e.select("id", F.greatest(F.least("value", "high"), "low").alias("start"))


@query(f"""WITH {E_SQL}, b AS (SELECT user_id, min(value) AS origin, max(value) AS furthest FROM e GROUP BY 1)
 SELECT id, floor((origin + (value - origin) * CASE WHEN furthest > origin + 60 THEN 60 / (furthest - origin) ELSE 1.0::DOUBLE END) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS start FROM e JOIN b USING (user_id)""")
def affine_squeeze(spark: SparkSession, sf: str) -> DataFrame:
    """A user's starts squeezed into 60 seconds from the first of them, if they reach further."""
    e = timed._events(spark, sf)
    b = e.groupBy("user_id").agg(F.min("value").alias("origin"), F.max("value").alias("furthest"))
    scale = F.when(F.col("furthest") > F.col("origin") + 60, 60 / (F.col("furthest") - F.col("origin"))).otherwise(1.0)
    return e.join(b, "user_id").select("id", micro(F.col("origin") + (F.col("value") - F.col("origin")) * scale).alias("start"))


@query(f"""WITH {E_SQL}, p AS (SELECT id, row_number() OVER {W_SQL} - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n, min(value) OVER (PARTITION BY user_id) AS a, max(value) OVER (PARTITION BY user_id) AS b FROM e)
 SELECT id, floor((a + (b - a) * k / n) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS start FROM p""")
def even_spread(spark: SparkSession, sf: str) -> DataFrame:
    """A user's units spread evenly from the first start to the last."""
    e = timed._events(spark, sf)
    b = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("a"), F.max("value").alias("b"))
    k = e.select("user_id", "id", (F.row_number().over(in_time()) - 1).alias("k"))
    return k.join(b, "user_id").select("id", micro(F.col("a") + (F.col("b") - F.col("a")) * F.col("k") / F.col("n")).alias("start"))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_quantity)::BIGINT AS u FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(100.0::DOUBLE * (sum(u) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) - u)::BIGINT / sum(u) OVER (PARTITION BY l_orderkey)::BIGINT * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS start FROM w""")
def weighted_spread(spark: SparkSession, sf: str) -> DataFrame:
    """An order's lines spread over 100 seconds by their quantities."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    u = F.floor("l_quantity")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", u.alias("u"))
    rows = rows.withColumn("before", F.sum("u").over(w) - F.col("u")).withColumn("all", F.sum("u").over(Window.partitionBy("l_orderkey")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", micro(F.lit(100.0) * F.col("before") / F.col("all")).alias("start"))


@query(r"""SELECT conv_id, turn, floor(10.0::DOUBLE * length(w) / n * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS cut FROM
 (SELECT conv_id, turn, length(text) AS n, regexp_extract(text, '^[^\x20\x09-\x0D]+') AS w FROM conversations) WHERE w <> ''""")
def proportional_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Where a turn of 10 seconds is cut after its first word, by character offset."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"), F.regexp_extract("text", r"^[^\x20\x09-\x0D]+", 0).alias("w"))
    return rows.where("w <> ''").select("conv_id", "turn", micro(F.lit(10.0) * F.length("w") / F.col("n")).alias("cut"))


@query(f"WITH {E_SQL} SELECT id, count(*) FILTER (event_type = 'purchase') OVER w AS known, row_number() OVER w AS place FROM e WINDOW w AS {W_SQL}")
def prefix_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = timed._events(spark, sf)
    return e.select("id", F.sum(bought().cast("long")).over(in_time()).alias("known"), F.row_number().over(in_time()).cast("long").alias("place"))


@query(f"""WITH {E_SQL}, g AS (SELECT id, lead(value) OVER w - value AS after, value - lag(value) OVER w AS before FROM e WINDOW w AS {W_SQL})
 SELECT id, floor(least(0.5::DOUBLE, greatest(0.12::DOUBLE, 0.25::DOUBLE * coalesce(after, 2.0)), greatest(0.02::DOUBLE, 0.25::DOUBLE * coalesce(before, 2.0))) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS margin FROM g""")
def relative_margin(spark: SparkSession, sf: str) -> DataFrame:
    """How far a start may move: at most half a second, a quarter of the gaps on its sides."""
    after, before = F.lead("value").over(in_time()) - F.col("value"), F.col("value") - F.lag("value").over(in_time())
    side = lambda gap, least: F.greatest(F.lit(least), 0.25 * F.coalesce(gap, F.lit(2.0)))
    return timed._events(spark, sf).select("id", micro(F.least(F.lit(0.5), side(after, 0.12), side(before, 0.02))).alias("margin"))


@query(f"""WITH {E_SQL}, k AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS v FROM e)
 SELECT id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS low, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS high FROM k""")
def floor_and_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    """The last known value up to a unit and the first from it on."""
    v = F.when(bought(), F.col("value"))
    low = F.last(v, ignorenulls=True).over(in_time().rowsBetween(Window.unboundedPreceding, 0))
    return timed._events(spark, sf).select("id", low.alias("low"), F.last(v, ignorenulls=True).over(sequences.backwards(["user_id"], ["t", "id"]).rowsBetween(Window.unboundedPreceding, 0)).alias("high"))


@query(f"""WITH {E_SQL} SELECT user_id, id, t, after - 2500000 AS pulled FROM (SELECT *, row_number() OVER w AS k, lead(t) OVER w AS after FROM e WINDOW w AS {W_SQL}) WHERE k = 1 AND after - t > 2500000""")
def stranded_first(spark: SparkSession, sf: str) -> DataFrame:
    """First units more than 2.5 seconds before their second, pulled to that distance."""
    e = timed._events(spark, sf).select("user_id", "id", "t", F.row_number().over(in_time()).alias("k"), F.lead("t").over(in_time()).alias("after"))
    return e.where((F.col("k") == 1) & (F.col("after") - F.col("t") > 2_500_000)).select("user_id", "id", "t", (F.col("after") - 2_500_000).alias("pulled"))


@query(f"""WITH {E_SQL}, s AS (SELECT *, t + floor(value * 60000000)::BIGINT AS stop FROM e)
 SELECT id, stop, least(stop, coalesce(min(t) OVER (PARTITION BY user_id ORDER BY t, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), stop)) AS trimmed FROM s""")
def trimmed_tails(spark: SparkSession, sf: str) -> DataFrame:
    """Ends brought before every start that follows, in one pass from the right."""
    following = F.min("t").over(sequences.backwards(["user_id"], ["t", "id"]).rowsBetween(Window.unboundedPreceding, -1))
    e = timed._events(spark, sf).withColumn("stop", F.col("t") + F.floor(F.col("value") * 60_000_000))
    return e.select("id", "stop", F.least("stop", F.coalesce(following, "stop")).alias("trimmed"))


@query(f"WITH {E_SQL} SELECT id FROM (SELECT *, lead(event_type) OVER w AS nx, lag(event_type) OVER w AS pv FROM e WINDOW w AS {W_SQL}) WHERE nx IS DISTINCT FROM event_type OR pv IS NULL")
def single_of_doubled(spark: SparkSession, sf: str) -> DataFrame:
    """Of equal neighbours the last, but a user's leading unit always stays."""
    e = timed._events(spark, sf).select("id", "event_type", F.lead("event_type").over(in_time()).alias("nx"), F.lag("event_type").over(in_time()).alias("pv"))
    return e.where(~F.col("nx").eqNullSafe(F.col("event_type")) | F.col("pv").isNull()).select("id")


@query(f"WITH {E_SQL}, m AS (SELECT user_id, count(value) AS n, median(value) AS middle FROM e GROUP BY 1) SELECT user_id, n, CASE WHEN n >= 5 THEN middle ELSE 0.0::DOUBLE END AS usual FROM m WHERE n > 0")
def usual_offset(spark: SparkSession, sf: str) -> DataFrame:
    """The median offset, 0 where fewer than five are known."""
    m = robust.quantiles(timed._events(spark, sf).select("user_id", "value"), ["user_id"], "value", {"middle": 0.5})
    return m.select("user_id", "n", F.when(F.col("n") >= 5, F.col("middle")).otherwise(0.0).alias("usual"))


@query("""SELECT l_suppkey, count(*) AS n, floor(sum(floor(l_discount * 100 + 0.5)::BIGINT)::BIGINT * 1e4::DOUBLE / count(*) + 0.5) / 1e6::DOUBLE AS mean, count(*) FILTER (l_discount < 0.025) / count(*) AS weak FROM lineitem GROUP BY 1""")
def score_shares(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier's mean score and the share of weak ones."""
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("l_discount") * 100 + 0.5)).alias("s"), F.count_if(F.col("l_discount") < 0.025).alias("weak"))
    return g.select("l_suppkey", "n", (F.floor(F.col("s") * 1e4 / F.col("n") + 0.5) / 1e6).alias("mean"), (F.col("weak") / F.col("n")).alias("weak"))


@query(f"""WITH {E_SQL}, d AS (SELECT event_type, abs(value - 50) AS off FROM e WHERE value IS NOT NULL)
 SELECT event_type, count(*) AS n, median(off) AS middle, quantile_cont(off, 0.75) - quantile_cont(off, 0.25) AS spread, count(*) FILTER (off <= 0.3) AS close, count(*) FILTER (off <= 5) AS near, count(*) FILTER (off > 25) AS far FROM d GROUP BY 1""")
def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Median error, quartile spread and how many are close, near and far."""
    off = F.abs(F.col("value") - 50)
    d = timed._events(spark, sf).where("value is not null").select("event_type", off.alias("off"))
    n = d.groupBy("event_type").agg(F.count_if(F.col("off") <= 0.3).alias("close"), F.count_if(F.col("off") <= 5).alias("near"), F.count_if(F.col("off") > 25).alias("far"))
    q = robust.quantiles(d, ["event_type"], "off", {"middle": 0.5, "low": 0.25, "high": 0.75})
    return q.join(n, "event_type").select("event_type", "n", "middle", (F.col("high") - F.col("low")).alias("spread"), "close", "near", "far")


@query(f"WITH {E_SQL} SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') / count(*) AS heard FROM e GROUP BY ROLLUP (user_id)")
def share_heard(spark: SparkSession, sf: str) -> DataFrame:
    """The share of pinned units, per user and over all (user null)."""
    return timed._events(spark, sf).rollup("user_id").agg(F.count(F.lit(1)).alias("n"), (F.count_if(bought()) / F.count(F.lit(1))).alias("heard"))


@query(f"""WITH {E_SQL}, g AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') / count(*) AS share, max(t) AS ended FROM e GROUP BY 1)
 SELECT *, CASE WHEN share >= 0.5 THEN 'checked' WHEN share > 0 THEN 'partial' ELSE 'not-found' END AS status FROM g""")
def coverage_status(spark: SparkSession, sf: str) -> DataFrame:
    g = timed._events(spark, sf).groupBy("user_id").agg((F.count_if(bought()) / F.count(F.lit(1))).alias("share"), F.max("t").alias("ended"))
    return g.withColumn("status", F.when(F.col("share") >= 0.5, "checked").when(F.col("share") > 0, "partial").otherwise("not-found"))


GATE_SQL = f"""WITH {E_SQL}, s AS (SELECT user_id, value, t - lag(t) OVER {W_SQL} AS gap FROM e),
 g AS (SELECT user_id, count(*) AS n, count(*) FILTER (value < 0 OR value > 95) AS outside, count(*) FILTER (gap <= 0) AS unordered, count(*) FILTER (gap < 80000) AS squeezed, count(*) FILTER (value < 10) AS weak, max(gap) AS most FROM s GROUP BY 1)
 SELECT user_id, n, outside, unordered, squeezed, weak, list_filter(['outside', 'unordered', 'squeezed', 'weak', 'jump'], lambda x, i: [outside > 0, unordered > 0, squeezed > 0, weak / n > 0.2, coalesce(most > 864000000000, false)][i]) AS issues FROM g"""


@query("SELECT * REPLACE (array_to_string(issues, ',') AS issues) FROM (" + GATE_SQL + ")")
def issue_gate(spark: SparkSession, sf: str) -> DataFrame:
    """A user's issues: starts out of range, not increasing, squeezed under 80 ms, weak, jumps."""
    s = timed._events(spark, sf).select("user_id", "value", (F.col("t") - F.lag("t").over(in_time())).alias("gap"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    v, gap = F.col("value"), F.col("gap")
    g = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), count((v < 0) | (v > 95)).alias("outside"), count(gap <= 0).alias("unordered"), count(gap < 80_000).alias("squeezed"), count(v < 10).alias("weak"), F.max("gap").alias("most"))
    issue = lambda c, name: F.when(c, F.lit(name))
    issues = F.concat_ws(",", issue(F.col("outside") > 0, "outside"), issue(F.col("unordered") > 0, "unordered"), issue(F.col("squeezed") > 0, "squeezed"), issue(F.col("weak") / F.col("n") > 0.2, "weak"), issue(F.col("most") > 864_000_000_000, "jump"))
    return g.select("user_id", "n", "outside", "unordered", "squeezed", "weak", issues.alias("issues"))


@query(f"""WITH {E_SQL} SELECT id, CASE WHEN low IS NOT NULL AND value < low - 1 THEN low ELSE value END AS start, CASE WHEN low IS NOT NULL AND value < low - 1 THEN 'clamped' ELSE 'kept' END AS status
 FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN value END) OVER (PARTITION BY user_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS low FROM e)""")
def clamp_strays(spark: SparkSession, sf: str) -> DataFrame:
    """Starts over a second before the greatest known start up to them are put there."""
    low = F.max(F.when(bought(), F.col("value"))).over(in_time().rowsBetween(Window.unboundedPreceding, 0))
    e = timed._events(spark, sf).withColumn("low", low)
    stray = F.coalesce(F.col("value") < F.col("low") - 1, F.lit(False))
    return e.select("id", F.when(stray, F.col("low")).otherwise(F.col("value")).alias("start"), F.when(stray, "clamped").otherwise("kept").alias("status"))


@query(f"""WITH {E_SQL} SELECT id, CASE WHEN gain >= 0.08 THEN 'apply' WHEN gain >= 0.04 THEN 'flag' ELSE 'leave' END AS tier, (gain > 0.03 AND d2 > 0.03) OR gain > 0.06 AS doubtful
 FROM (SELECT id, floor(value)::BIGINT % 10 / 100.0::DOUBLE AS gain, id % 10 / 100.0::DOUBLE AS d2 FROM e)""")
def reading_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """What a better reading's gain leads to, and whether two listeners doubt a word."""
    e = timed._events(spark, sf).select("id", (F.floor("value") % 10 / 100.0).alias("gain"), (F.col("id") % 10 / 100.0).alias("d2"))
    tier = F.when(F.col("gain") >= 0.08, "apply").when(F.col("gain") >= 0.04, "flag").otherwise("leave")
    return e.select("id", tier.alias("tier"), (((F.col("gain") > 0.03) & (F.col("d2") > 0.03)) | (F.col("gain") > 0.06)).alias("doubtful"))


@query(f"""WITH {E_SQL}, k AS (SELECT id, greatest(0, floor(value * 1000 + 0.5)::BIGINT) AS ms, greatest(0, floor(value * 100 + 0.5)::BIGINT) AS c FROM e)
 SELECT id, printf('%d.%03d', ms // 1000, ms % 1000) AS ttml, printf('%d:%02d.%02d', c // 6000, c // 100 % 60, c % 100) AS clock FROM k""")
def clock_formats(spark: SparkSession, sf: str) -> DataFrame:
    return timed._events(spark, sf).select("id", scripts.ttml(F.col("value")).alias("ttml"), scripts.clock(F.col("value")).alias("clock"))


@query("""SELECT user_id, count(*) AS n, min(s) AS first, max(s) AS last FROM (SELECT DISTINCT user_id, floor((value + 0.05::DOUBLE) * 100 + 0.5) / 100.0 AS s FROM events WHERE value IS NOT NULL) GROUP BY 1""")
def embedded_starts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct starts with the lead of 0.05 restored: their number, the first and the last."""
    s = timed._events(spark, sf).where("value is not null").select("user_id", cents(F.col("value") + 0.05).alias("s")).distinct()
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first"), F.max("s").alias("last"))


@query(f"""WITH {E_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 50) DESC, id) AS k FROM e WHERE value IS NOT NULL)
 SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY t, id)::INT AS place FROM r WHERE k <= 8""")
def furthest_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """A user's eight furthest units, back in order of time."""
    by_size = Window.partitionBy("user_id").orderBy(F.desc(F.abs(F.col("value") - 50)), "id")
    r = timed._events(spark, sf).where("value is not null").withColumn("k", F.row_number().over(by_size)).where("k <= 8")
    return r.select("user_id", "id", F.row_number().over(in_time()).alias("place"))


@query(f"""WITH {E_SQL}, a AS (SELECT *, bool_and(event_type <> 'view') OVER (PARTITION BY user_id) AS timed FROM e)
 SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN timed THEN value END NULLS LAST, id) AS place FROM a""")
def order_if_timed(spark: SparkSession, sf: str) -> DataFrame:
    """Units by start where all of a user's are timed, else as they came; unknown starts last."""
    timed_all = F.bool_and(F.col("event_type") != "view").over(Window.partitionBy("user_id"))
    a = timed._events(spark, sf).withColumn("key", F.when(timed_all, F.col("value")))
    return a.select("user_id", "id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.asc_nulls_last("key"), "id")).cast("long").alias("place"))


@query("""WITH p AS (SELECT p_partkey AS id, p_brand || ' ' || p_type AS title, floor(p_retailprice * 100 + 0.5)::BIGINT AS d FROM part), k AS (SELECT *, regexp_replace(lower(title), '[^\\p{L}\\p{N}]', '', 'g') AS s FROM p)
 SELECT a.id, arg_min(b.id, (abs(a.d - b.d), b.id)) AS match_id, min(abs(a.d - b.d)) AS gap FROM k a JOIN k b ON a.s = b.s AND a.id <> b.id AND abs(a.d - b.d) <= 300 GROUP BY a.id""")
def same_title_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Of parts with the same squashed title the one nearest in length, within 3 seconds."""
    title = scripts.squash(F.concat_ws(" ", "p_brand", "p_type"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), title.alias("s"), F.floor(F.col("p_retailprice") * 100 + 0.5).alias("t"))
    return time_joins.nearest_other(p, ["s"], 300).where("match_id is not null").select("id", "match_id", "gap")


QUERIES, SQL = query.queries, query.sql
