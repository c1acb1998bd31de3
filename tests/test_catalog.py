"""Every catalogue query against its SQL, and small cases of the operators."""

import pytest
from compare import difference
from pyspark.sql import functions as F

from chronotext import catalog
from chronotext.functions import timecodes
from chronotext.operators import robust, sequences, time_joins
from chronotext.plans import aligned
from chronotext.sources import sheets

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - set(aligned.SQL)))
def test_query(spark, name):
    assert difference(spark, catalog.queries()[name], catalog.oracle_sql()[name], SF) == ""


def test_sheet_parser(spark):
    text = "\ufeff[ti:x]\n[00:01.5] [01:02.250]two stamps\n\nplain\n[0:03]short\r\n[00:04.00]\n@Ruby1=a,b\nsung [00:05.00]later[00:06.00] on\n[00:1]odd"
    got = {tuple(r) for r in sheets.parse(spark.createDataFrame([("a", text), ("b", None)], "key string, text string")).collect()}
    assert got == {("a", 2, 1.5, "two stamps"), ("a", 2, 62.25, "two stamps"), ("a", 4, None, "plain"), ("a", 5, 3.0, "short"), ("a", 8, 5.0, "sung later on")}


def test_stamps_clamp_and_round(spark):
    df = spark.createDataFrame([(-1.0,), (61.005,), (None,)], "x double").select(timecodes.stamp(F.col("x")).alias("s"))
    assert [r.s for r in df.collect()][:2] == ["[00:00.00]", "[01:01.01]"]


def test_nearest_ties_and_empty(spark):
    a = spark.createDataFrame([("k", 1, 10), ("k", 2, 100), ("z", 3, 5)], "user string, id long, t long")
    b = spark.createDataFrame([("k", 9, 8), ("k", 8, 12), ("k", 7, 8)], "user string, id long, t long")
    got = {r.id: (r.match_id, r.gap) for r in time_joins.nearest(a, b, ["user"], 5).collect()}
    assert got == {1: (7, 2), 2: (None, None), 3: (None, None)}
    assert time_joins.nearest(a.where("false"), b, ["user"], 5).count() == 0


def test_quantiles_fold_repeats(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 1.0, 1.0, 5.0)] + [("b", None)], "k string, v double")
    assert [tuple(r) for r in robust.quantiles(df, ["k"], "v", {"p": 0.75, "m": 0.5}).collect()] == [("a", 4, 2.0, 1.0)]


def test_blocks(spark):
    df = spark.createDataFrame([(1, i) for i in (0, 1, 2, 5, 6)], "k int, i long")
    assert {tuple(r) for r in sequences.index_blocks(df, ["k"], "i").collect()} == {(1, 0, 2, 3), (1, 5, 6, 2)}


def test_callers_names_stay(spark):
    names = ["side", "same", "before", "after", "pick", "k", "v", "n", "upto", "off", "limit", "gap"]
    more = [F.lit("x").alias(c) for c in names]
    a = spark.createDataFrame([("k", 1, 10), (None, 2, 10)], "user string, id long, t long").select("*", *more)
    b = spark.createDataFrame([("k", 9, 8), (None, 7, 12)], "user string, id long, t long")
    got = {r.id: (r.match_id, r.gap, r.side, r.before, r.pick) for r in time_joins.nearest(a, b, ["user"], 5).collect()}
    assert got == {1: (9, 2, "x", "x", "x"), 2: (7, 2, "x", "x", "x")}
    d = robust.deviations(a.drop("n", "limit"), ["v", "k"], "t", least=1).collect()
    assert {(r.off, r.upto, r.n, r.flagged) for r in d} == {("x", "x", 2, False)}
    assert sequences.collapsed(a.withColumn("_p", F.lit(1)), ["k"], "id", "v").collect()[0]["_p"] == 1


def test_band_counts_and_keys(spark):
    a = spark.createDataFrame([("k", 1, 10), ("k", 2, 30), ("z", 3, 5)], "user string, id long, t long")
    b = spark.createDataFrame([("k", 8, 8), ("k", 9, 10), ("k", 7, 12), ("q", 6, 5)], "user string, id long, t long")
    assert {r.id: r.n for r in time_joins.counts_in_band(a, b, ["user"], 2, 2).collect()} == {1: 3, 2: 0, 3: 0}
    assert time_joins.counts_in_band(a, b.where("false"), ["user"], 2, 2).agg(F.sum("n")).first()[0] == 0
    assert {tuple(r) for r in time_joins.mutual_nearest(a, b, ["user"], 5).collect()} == {("k", 1, 9, 0)}
    old = spark.createDataFrame([("k", 0), (None, 1), ("o", 2)], "user string, x long")
    fresh = spark.createDataFrame([("k", 5)], "user string, x long")
    assert {tuple(r) for r in time_joins.upsert(fresh, old, ["user"]).collect()} == {("k", 5), (None, 1), ("o", 2)}
    moved = time_joins.migrate_keys(old, spark.createDataFrame([("k", "n")], "old string, new string"), "user")
    assert {tuple(r) for r in moved.collect()} == {("n", 0), (None, 1), ("o", 2)}
