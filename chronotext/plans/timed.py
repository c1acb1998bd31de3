"""Queries over events, orders and line items: time joins, sequences, robust statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.functions import timecodes
from chronotext.operators import robust, sequences, time_joins
from chronotext.sources.sheets import export, table
from chronotext.streaming import windows

MINUTE = 60_000_000
T_SQL = "epoch_us(ts)::BIGINT"
#: SQL views of the two sides of the time joins.
SIDES_SQL = f"""e AS (SELECT user_id, event_type, event_id AS id, {T_SQL} AS t, value, ts FROM events),
l AS (SELECT * FROM e WHERE event_type <> 'purchase'), r AS (SELECT * FROM e WHERE event_type = 'purchase')"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("id"), timecodes.micros("ts").alias("t"), "value")


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, sf)
    return (e.where(F.col("event_type") != "purchase").select("user_id", "id", "t"), e.where(F.col("event_type") == "purchase").select("user_id", "id", "t"))


def nearest_event(spark: SparkSession, sf: str) -> DataFrame:
    return time_joins.nearest(*_sides(spark, sf), ["user_id"], 600 * MINUTE)


NEAREST_SQL = """SELECT user_id, id, t, match_id, gap FROM (SELECT l.user_id, l.id, l.t, r.id AS match_id, abs(l.t - r.t) AS gap,
 row_number() OVER (PARTITION BY l.id ORDER BY abs(l.t - r.t) NULLS LAST, r.t, r.id) AS k
 FROM {0} l LEFT JOIN {1} r ON l.user_id = r.user_id AND abs(l.t - r.t) <= 36000000000) WHERE k = 1"""


def mutual_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return time_joins.mutual_nearest(*_sides(spark, sf), ["user_id"], 600 * MINUTE)


def interval_cover(spark: SparkSession, sf: str) -> DataFrame:
    return time_joins.counts_in_band(*_sides(spark, sf), ["user_id"], 720 * MINUTE, 900 * MINUTE)


def close_time_groups(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.gap_runs(_events(spark, sf), ["user_id"], 60 * MINUTE)


def heard_runs(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.gap_runs(_events(spark, sf), ["user_id"], 600 * MINUTE, least=3)


def _runs_sql(gap: int, least: int) -> str:
    return f"""WITH e AS (SELECT user_id, event_id AS id, {T_SQL} AS t FROM events),
 b AS (SELECT *, coalesce(t - lag(t) OVER w > {gap}, false)::INT AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, id)),
 g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, id) AS g FROM b)
 SELECT user_id, min(t) AS started, max(t) AS ended, count(*) AS n FROM g GROUP BY user_id, g HAVING count(*) >= {least}"""


def next_known_start(spark: SparkSession, sf: str) -> DataFrame:
    known = F.when(F.col("event_type") == "purchase", F.col("t"))
    return _events(spark, sf).select("id", "user_id", "t", sequences.next_known(None, ["user_id"], ["t", "id"], known).alias("next_start"))


def running_bounds(spark: SparkSession, sf: str) -> DataFrame:
    low, high = sequences.bounds("value", ["user_id"], ["t", "id"])
    return _events(spark, sf).select("id", low.alias("most_so_far"), high.alias("least_to_come"))


def adjacent_order_check(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("id")
    late = _events(spark, sf).withColumn("previous", F.lag("value").over(w)).where("value <= previous")
    return late.select("user_id", "id", "value", "previous")


def overlap_tails(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t", "id")
    e = _events(spark, sf).withColumn("ended", F.col("t") + F.floor(F.col("value") * 60_000_000)).withColumn("next_t", F.lead("t").over(w))
    return e.where("ended > next_t").select("user_id", "id", "ended", "next_t", F.least("ended", "next_t").alias("trimmed"))


def smoothed_silence(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of at least 3 rows whose 7-tap mean value is below 40."""
    w = Window.partitionBy("user_id").orderBy("t", "id")
    cents = F.floor(F.col("value") * 100 + 0.5)
    taps = w.rowsBetween(-3, 3)
    e = _events(spark, sf).withColumn("quiet", F.sum(cents).over(taps) < 4000 * F.count(F.lit(1)).over(taps)).withColumn("place", F.row_number().over(w).cast("long"))
    return sequences.index_blocks(e.where("quiet"), ["user_id"], "place").where("n >= 3")


def offset_pattern(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select("user_id", "id", (F.col("value") / 100).alias("x"))
    return robust.deviations(e, ["user_id"], "x", least=8, widest=0.35).select("user_id", "id", "centre", "spread", "flagged")


OFFSET_SQL = """WITH e AS (SELECT user_id, event_id AS id, value / 100 AS x FROM events WHERE value IS NOT NULL),
 c AS (SELECT user_id, count(*) AS n, list_sort(list(x))[count(*) // 2 + 1] AS centre FROM e GROUP BY 1),
 o AS (SELECT e.*, n, centre, abs(x - centre) AS off FROM e JOIN c USING (user_id)),
 s AS (SELECT user_id, list_sort(list(off))[count(*) // 2 + 1] AS spread FROM o GROUP BY 1)
 SELECT user_id, id, centre, spread, n >= 8 AND spread <= 0.35 AND off > least(1.0::DOUBLE, greatest(0.4::DOUBLE, 6 * spread)) AS flagged FROM o JOIN s USING (user_id)"""


def densest_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Per user the value with the most others within 1, the smallest of such."""
    best = near_values(spark, sf).groupBy("user_id").agg(F.max(F.struct("n", (-F.col("t")).alias("minus"))).alias("b"))
    return best.where("b.n >= 3").select("user_id", (-F.col("b.minus")).alias("cents"), F.col("b.n").alias("near"))


def near_values(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, id, t, n): values in hundredths, and how many of the user's lie within 1."""
    e = _events(spark, sf).select("user_id", "id", F.floor(F.col("value") * 100 + 0.5).alias("t")).where("t is not null")
    return time_joins.counts_in_band(e, e, ["user_id"], 100, 100)


def applied_edit_totals(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.floor(F.col("value") * 100 + 0.5)
    return _events(spark, sf).groupBy("user_id").agg(F.sum(cents).alias("cents"), F.max_by("event_type", F.struct("t", "id")).alias("last_type"))


def approval_staleness(spark: SparkSession, sf: str) -> DataFrame:
    """Users whose last other event came after their last purchase."""
    buy = F.col("event_type") == "purchase"
    a = _events(spark, sf).groupBy("user_id").agg(F.max(F.when(buy, F.col("t"))).alias("approved"), F.max(F.when(~buy, F.col("t"))).alias("changed"))
    return a.where("approved is not null").select("user_id", "approved", "changed", F.coalesce(F.col("changed") > F.col("approved"), F.lit(False)).alias("stale"))


def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sliding_counts(table(spark, sf, "events")).select("event_type", timecodes.micros("started").alias("started"), "n")


def voice_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sessions(table(spark, sf, "events")).select("user_id", timecodes.micros("started").alias("started"), "n")


def timecode_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    stamp = timecodes.stamp(F.col("value"))
    return _events(spark, sf).select("id", stamp.alias("stamp"), timecodes.stamp(F.col("value"), ":").alias("tag"), timecodes.half_up(timecodes.seconds_of(stamp), 2).alias("seconds"))


def lrc_export(spark: SparkSession, sf: str) -> DataFrame:
    return export(_events(spark, sf), ["user_id", "event_type"], "value", "event_type", ["value", "id"])


def known_key_anti(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def covered_semi(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


def key_migration(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("old"), F.substring(F.sha2("c_name", 256), 1, 12).alias("new"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("key"))
    return time_joins.migrate_keys(o, c, "key").select("o_orderkey", "key")


def inventory_report(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    j = table(spark, sf, "customer").join(o, "c_custkey", "left")
    return j.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("finished", F.lit(0)).alias("finished"), F.when(F.col("n").isNull(), "missing").when(F.col("n") == F.col("finished"), "done").otherwise("open").alias("status"))


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def change_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    q = robust.quantiles(table(spark, sf, "lineitem"), ["l_shipdate"], "l_quantity", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "most": 1.0})
    return q


def robust_spread(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity")
    m = robust.quantiles(rows, ["l_suppkey"], "l_quantity", {"middle": 0.5})
    off = rows.join(m, "l_suppkey").withColumn("off", F.abs(F.col("l_quantity") - F.col("middle")))
    return m.join(robust.quantiles(off, ["l_suppkey"], "off", {"spread": 0.5}).drop("n"), "l_suppkey")


def top_moves(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return sequences.top(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 10).select("l_suppkey", "l_extendedprice", "place")


def clamp_shift(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.greatest(F.lit(0.0), timecodes.half_up(F.col("l_quantity") - 12.345, 2))
    return table(spark, sf, "lineitem").groupBy("l_returnflag", moved.alias("moved")).agg(F.count(F.lit(1)).alias("n"))


def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the share of weak lines and whether they pass without review."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.075).alias("weak"))
    share = F.col("weak") / F.col("n")
    return g.select("l_orderkey", "n", "weak", F.when(share > 0.5, "review").when(share > 0.2, "warn").otherwise("pass").alias("gate"))


QUERIES = {f.__name__: f for f in (nearest_event, mutual_nearest, interval_cover, close_time_groups, heard_runs, next_known_start, running_bounds, adjacent_order_check, overlap_tails, smoothed_silence, offset_pattern, densest_shift, applied_edit_totals, approval_staleness, sliding_windows, voice_sessions, timecode_roundtrip, lrc_export, known_key_anti, covered_semi, key_migration, inventory_report, status_counts, change_percentiles, robust_spread, top_moves, clamp_shift, quality_gate)}

_STAMP = "printf('[%02d:%02d{0}%02d]', (k // 6000)::BIGINT, (k // 100 % 60)::BIGINT, (k % 100)::BIGINT)"
_TICKS = "greatest(0, floor(value * 100 + 0.5)::BIGINT)"

SQL = {
    "nearest_event": f"WITH {SIDES_SQL} " + NEAREST_SQL.format("l", "r"),
    "mutual_nearest": f"WITH {SIDES_SQL}, a AS ({NEAREST_SQL.format('l', 'r')}), b AS ({NEAREST_SQL.format('r', 'l')}) SELECT a.user_id, a.id AS left_id, b.id AS right_id, a.gap FROM a JOIN b ON a.match_id = b.id AND b.match_id = a.id",
    "interval_cover": f"WITH {SIDES_SQL} SELECT l.user_id, l.id, l.t, count(r.id) AS n FROM l LEFT JOIN r ON l.user_id = r.user_id AND r.t BETWEEN l.t - 43200000000 AND l.t + 54000000000 GROUP BY ALL",
    "close_time_groups": _runs_sql(60 * MINUTE, 1),
    "heard_runs": _runs_sql(600 * MINUTE, 3),
    "next_known_start": f"WITH {SIDES_SQL} SELECT id, user_id, t, first_value(CASE WHEN event_type = 'purchase' THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_start FROM e",
    "running_bounds": f"WITH {SIDES_SQL} SELECT id, max(value) OVER (PARTITION BY user_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS most_so_far, min(value) OVER (PARTITION BY user_id ORDER BY t, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least_to_come FROM e",
    "adjacent_order_check": f"WITH {SIDES_SQL} SELECT user_id, id, value, previous FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY id) AS previous FROM e) WHERE value <= previous",
    "overlap_tails": f"WITH {SIDES_SQL} SELECT user_id, id, ended, next_t, least(ended, next_t) AS trimmed FROM (SELECT *, t + floor(value * 60000000)::BIGINT AS ended, lead(t) OVER (PARTITION BY user_id ORDER BY t, id) AS next_t FROM e) WHERE ended > next_t",
    "smoothed_silence": f"""WITH {SIDES_SQL}, q AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, id) AS place,
 sum(floor(value * 100 + 0.5)::BIGINT) OVER w < 4000 * count(*) OVER w AS quiet FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
 b AS (SELECT *, place - row_number() OVER (PARTITION BY user_id ORDER BY place) AS g FROM q WHERE quiet)
 SELECT user_id, min(place) AS first_index, max(place) AS last_index, count(*) AS n FROM b GROUP BY user_id, g HAVING count(*) >= 3""",
    "offset_pattern": OFFSET_SQL,
    "densest_shift": """WITH e AS (SELECT user_id, floor(value * 100 + 0.5)::BIGINT AS cents FROM events), n AS (SELECT user_id, cents, count(*) OVER (PARTITION BY user_id ORDER BY cents RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near FROM e)
 SELECT user_id, cents, near FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY near DESC, cents) AS k FROM n) WHERE k = 1 AND near >= 3""",
    "applied_edit_totals": f"WITH {SIDES_SQL} SELECT user_id, sum(floor(value * 100 + 0.5)::BIGINT)::BIGINT AS cents, arg_max(event_type, (t, id)) AS last_type FROM e GROUP BY user_id",
    "approval_staleness": f"WITH {SIDES_SQL}, a AS (SELECT user_id, max(t) FILTER (event_type = 'purchase') AS approved, max(t) FILTER (event_type <> 'purchase') AS changed FROM e GROUP BY 1) SELECT *, coalesce(changed > approved, false) AS stale FROM a WHERE approved IS NOT NULL",
    "sliding_windows": f"SELECT event_type, (({T_SQL} // 600000000) - o) * 600000000 AS started, count(*) AS n FROM events, (VALUES (0), (1)) AS v(o) GROUP BY ALL",
    "voice_sessions": f"""WITH e AS (SELECT user_id, event_id AS id, {T_SQL} AS t FROM events), b AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, id) >= 1800000000, false)::INT AS b FROM e),
 g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, id) AS g FROM b) SELECT user_id, min(t) AS started, count(*) AS n FROM g GROUP BY user_id, g""",
    "timecode_roundtrip": f"SELECT id, {_STAMP.format('.')} AS stamp, {_STAMP.format(':')} AS tag, k / 100.0::DOUBLE AS seconds FROM (SELECT event_id AS id, {_TICKS} AS k FROM events)",
    "lrc_export": f"SELECT user_id, event_type, string_agg({_STAMP.format('.')} || event_type, chr(10) ORDER BY value, id) AS sheet FROM (SELECT *, event_id AS id, {_TICKS} AS k FROM events) GROUP BY ALL",
    "known_key_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "covered_semi": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "key_migration": "SELECT o_orderkey, coalesce(substr(sha256(c_name), 1, 12), o_custkey::VARCHAR) AS key FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey",
    "inventory_report": "SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished, CASE WHEN count(o_orderkey) = 0 THEN 'missing' WHEN count(o_orderkey) = count(*) FILTER (o_orderstatus = 'F') THEN 'done' ELSE 'open' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "status_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    "change_percentiles": "SELECT l_shipdate, count(*) AS n, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.75) AS p75, max(l_quantity) AS most FROM lineitem GROUP BY 1",
    "robust_spread": "WITH m AS (SELECT l_suppkey, count(*) AS n, median(l_quantity) AS middle FROM lineitem GROUP BY 1) SELECT l_suppkey, any_value(n) AS n, any_value(middle) AS middle, median(abs(l_quantity - middle)) AS spread FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1",
    "top_moves": "SELECT l_suppkey, l_extendedprice, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem) WHERE place <= 10",
    "clamp_shift": "SELECT l_returnflag, greatest(0.0::DOUBLE, floor((l_quantity - 12.345::DOUBLE) * 100 + 0.5) / 100.0) AS moved, count(*) AS n FROM lineitem GROUP BY ALL",
    "quality_gate": "SELECT l_orderkey, n, weak, CASE WHEN weak / n > 0.5 THEN 'review' WHEN weak / n > 0.2 THEN 'warn' ELSE 'pass' END AS gate FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_discount > 0.075) AS weak FROM lineitem GROUP BY 1)",
}
