"""Readings, languages and names on hand-made texts."""

from pyspark.sql import functions as F

from chronotext.functions import scripts

TEXTS = ["한국어 걸어", "강아지", "안녕", "漢字かな", "привет", "two words 漢字", "one 漢字", "é", "12 - !", "", None, "カタカナ"]


def test_languages(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r.l for r in df.select(scripts.language(F.col("t")).alias("l")).collect()]
    assert got == ["ko", "ko", "ko", "ja", "ru", "en", "zh", "en", "unknown", "unknown", "unknown", "ja"]


def test_readings(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS[:3] + ["a한b", "", None]], "t string")
    got = [r.r for r in df.select(scripts.romanised(F.col("t")).alias("r")).collect()]
    assert got[:5] == [["han", "gu", "geo", "", "geo", "reo"], ["gang", "a", "ji"], ["an", "nyeong"], ["", "han", ""], []]
    assert not got[5]


def test_names_and_clocks(spark):
    df = spark.createDataFrame([("A (live) [x] feat. B", 61.2345), ("a/b", -1.0), ("", None)], "t string, s double")
    rows = df.select(scripts.title(F.col("t")).alias("title"), scripts.valid_name(F.col("t")).alias("ok"), scripts.ttml(F.col("s")).alias("ttml"), scripts.clock(F.col("s")).alias("clock"), scripts.hiragana(F.lit("カン")).alias("h"), scripts.xml_text(F.lit("<&\""), True).alias("x")).collect()
    assert [r.title for r in rows] == ["A", "a/b", ""] and [r.ok for r in rows] == [True, False, False]
    assert rows[0].ttml == "61.235" and rows[0].clock == "1:01.23" and rows[1].ttml == "0.000"
    assert rows[0].h == "かん" and rows[0].x == "&lt;&amp;&quot;"


def test_languages_of_sheets(spark):
    """Three rows in a script of their own decide, Japanese first; English beside Chinese counts
    from three rows and six tenths on."""
    from chronotext.plans import sheetwork

    cases = {"ja": "zh zh zh zh ja ja ja", "zh": "zh zh zh ja ja", "en": "zh zh zh zh zh en en en", "zh ": "zh zh zh zh zh zh en en en", "ja ": "ru ru ru ja ja ja ru", "ko": "ko ko ko en en en en", "en ": "en zh", "zh  ": "zh en"}
    rows = [(k, i, x) for k, v in cases.items() for i, x in enumerate(v.split())]
    got = sheetwork.sheet_language(spark.createDataFrame(rows, "k string, i int, lang string"), ["k"], "i", F.col("lang")).collect()
    assert {r.k: r.lang for r in got} == {k: k.strip() for k in cases}
