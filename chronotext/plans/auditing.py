"""Queries that hold lines against pages and earlier rows, put readings into lines, move whole
trees of times, and watch slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.functions import texts, trees
from chronotext.operators import locating, readings
from chronotext.plans.folding import _PLACES, _symbols
from chronotext.plans.registry import Registry
from chronotext.sources import sheets
from chronotext.sources.sheets import table
from chronotext.streaming import slots

query = Registry()


def _page(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(pages, lines): a document's words as pieces, read in capitals, and its lines without
    blanks, those of odd documents in two halves that are exchanged."""
    docs = table(spark, sf, "documents").where("doc_id is not null")
    pieces = F.transform(texts.words(F.col("text")), lambda w: F.struct(w.alias("base"), F.upper(w).alias("reading")))
    own = docs.select("doc_id", F.posexplode(texts.lines(F.col("text"))).alias("n", "line"), F.size(texts.lines(F.col("text"))).alias("of"))
    place = F.when(F.col("doc_id") % 2 == 1, (F.col("n") + F.floor(F.col("of") / 2)) % F.col("of")).otherwise(F.col("n"))
    return docs.select("doc_id", pieces.alias("pieces")), own.select("doc_id", place.alias("place"), F.regexp_replace("line", r"[\x20\x09-\x0D]+", "").alias("text"))


@query()
def located_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Where each line of a document stands in it, repeated lines at their own places."""
    return locating.located(*_page(spark, sf), ["doc_id"])


def _two_versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(lines, old) of each user: its events as lines, and those before without some of them,
    a little earlier or later; users of a number divisible by three lose none."""
    s = _symbols(spark, sf)
    text = F.concat(F.lit("line "), F.col("cents") % 19)
    lines = s.select("user_id", "place", (F.col("place") * 2.0).alias("start"), text.alias("text"))
    old = s.where((F.col("user_id") % 3 == 0) | (F.col("cents") % 5 != 0)).select("user_id", "place", (F.col("place") * 2.0 + (F.col("cents") % 41) / 10).alias("start"), text.alias("text"))
    return lines, old.withColumn("start", F.floor("start"))


@query(f"""WITH {_PLACES}, l AS (SELECT user_id, place, place * 2.0::DOUBLE AS start, 'line ' || cents % 19 AS text, row_number() OVER (PARTITION BY user_id ORDER BY place) AS k FROM s),
 earlier AS (SELECT user_id, place, floor(place * 2.0::DOUBLE + (cents % 41) / 10) AS start, 'line ' || cents % 19 AS text FROM s WHERE user_id % 3 = 0 OR cents % 5 <> 0),
 f AS (SELECT user_id, start, row_number() OVER (PARTITION BY user_id ORDER BY min(place)) AS k FROM earlier GROUP BY user_id, start),
 p AS (SELECT user_id FROM (SELECT user_id, count(*) AS n FROM l GROUP BY 1) JOIN (SELECT user_id, count(*) AS m FROM f GROUP BY 1) USING (user_id) WHERE n = m),
 m AS (SELECT l.user_id, l.start, f.start AS old_start FROM l JOIN p USING (user_id) JOIN f ON f.user_id = l.user_id AND f.k = l.k),
 t AS (SELECT user_id, list((place, start, text) ORDER BY place) AS own FROM l WHERE user_id NOT IN (SELECT user_id FROM p) GROUP BY 1),
 q AS (SELECT user_id, list((place, start, text) ORDER BY place) AS own FROM earlier WHERE user_id NOT IN (SELECT user_id FROM p) GROUP BY 1),
 c AS (SELECT user_id, list_reduce(list_prepend({{'c': 0::BIGINT, 'got': [], 'x': (0::BIGINT, 0.0::DOUBLE, ''), 'o': q.own}}, list_transform(t.own, lambda y: {{'c': 0::BIGINT, 'got': [], 'x': y, 'o': []}})),
   lambda a, y: {{'c': coalesce(a.c + list_position(list_transform(a.o[a.c + 1:], lambda z: z[3]), y.x[3]), a.c), 'got': CASE WHEN list_position(list_transform(a.o[a.c + 1:], lambda z: z[3]), y.x[3]) IS NULL THEN a.got ELSE a.got || [[y.x[2], a.o[a.c + list_position(list_transform(a.o[a.c + 1:], lambda z: z[3]), y.x[3])][2]]] END, 'x': y.x, 'o': a.o}}).got AS got FROM t JOIN q USING (user_id)),
 a AS (SELECT user_id, start, old_start FROM m UNION ALL SELECT user_id, x[1], x[2] FROM (SELECT user_id, unnest(got) AS x FROM c))
 SELECT user_id, count(*) AS matched, count(*) FILTER (abs(start - old_start) > 1) AS over_one, count(*) FILTER (abs(start - old_start) > 3) AS over_three FROM a GROUP BY 1""")
def matched_forward(spark: SparkSession, sf: str) -> DataFrame:
    """How many lines correspond to earlier rows, and how many of them have moved far."""
    got = locating.matched_forward(*_two_versions(spark, sf), ["user_id"])
    far = lambda s: F.count(F.when(F.abs(F.col("start") - F.col("old_start")) > s, 1))
    return got.groupBy("user_id").agg(F.count(F.lit(1)).alias("matched"), far(1).alias("over_one"), far(3).alias("over_three"))


LETTERS, SIGNS, SOUNDS = "abcdefghijklmnopqrstuvwxyz", "山水火木金土日月石田竹米糸羊耳肉虫貝車門雨馬魚鳥麦鼻", "あいうえおかきくけこさしすせそたちつてとなにぬねのは"


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, line, annotated, theirs): a turn's first words, the longer of them as two
    signs with a reading, and the reading that a page might have: some words are read from the
    end, and some lines have a word more."""
    words = F.slice(texts.words(F.lower("text")), 1, 9)
    long = lambda w, i: (F.length(w) >= 3) & (i % 3 != 2)
    base, sound = lambda w: F.translate(F.left(w, F.lit(2)), LETTERS, SIGNS), lambda w: F.translate(w, LETTERS, SOUNDS)
    every = lambda f: F.array_join(F.transform(words, f), "")
    annotated = every(lambda w, i: F.when(long(w, i), F.concat(F.lit("{"), base(w), F.lit("|"), sound(w), F.lit("}"))).otherwise(sound(w)))
    line = every(lambda w, i: F.when(long(w, i), base(w)).otherwise(sound(w)))
    theirs = every(lambda w, i: F.when(long(w, i) & (i % 4 == 1), F.reverse(sound(w))).otherwise(sound(w)))
    theirs = F.when(F.col("turn") % 5 == 3, F.concat(theirs, F.lit("よ"))).otherwise(theirs)
    rows = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", line.alias("line"), annotated.alias("annotated"), theirs.alias("theirs"))
    bare = lambda c: F.regexp_replace(c, f"[^ぁ-ゖー{readings.IDEOGRAPH}a-z0-9]", "")
    return rows.withColumn("theirs", bare(F.col("theirs"))).withColumn("line", bare(F.col("line")))


@query()
def reading_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of a line that a page reads differently, put into the line where they belong."""
    own = readings.columns()
    rows = _annotated(spark, sf).withColumn("diffs", own["differences"]("annotated", "theirs"))
    put = rows.select("conv_id", "turn", "diffs", own["written"]("line", "diffs").alias("w"))
    return put.select("conv_id", "turn", F.array_join(F.transform("diffs", lambda d: F.concat_ws(":", d["base"], d["ours"], d["theirs"])), ",").alias("diffs"), F.md5("w.line").alias("line_md5"), "w.done", "w.left")


def _trees(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, place, line): a turn's first twelve words, 0.5 s each, in syllables of two
    letters; every third word's have a reading."""
    words = F.slice(texts.words(F.col("text")), 1, 12)

    def word(w: Column, i: Column) -> Column:
        begin, n = i * 0.5, F.ceil(F.length(w) / 2)
        step = F.floor(F.lit(50) / n) / 100
        at = lambda k: F.floor((begin + step * k) * 100 + 0.5) / 100
        ruby = lambda k: F.when(i % 3 == 0, F.array(F.struct(F.lit("r").alias("text"), at(k).alias("startTime"), at(k + 1).alias("endTime"))))
        syllables = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: F.struct(F.substring(w, k * 2 + 1, F.lit(2)).alias("text"), at(k).alias("startTime"), at(k + 1).alias("endTime"), ruby(k).alias("ruby")))
        return F.struct(w.alias("text"), begin.alias("startTime"), (begin + 0.5).alias("endTime"), syllables.alias("syllables"))

    line = F.struct(F.coalesce("text", F.lit("")).alias("fullText"), F.lit(None).cast("string").alias("translation"), F.lit(0.0).alias("startTime"), (F.size(words) * 0.5).alias("endTime"), F.transform(words, word).alias("words"))
    return table(spark, sf, "conversations").where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").alias("place"), line.alias("line"))


@query(r"""WITH w AS (SELECT conv_id, turn, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')[:12] AS own FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
 d AS (SELECT conv_id, turn, own, CASE WHEN turn % 4 = 0 THEN NULL ELSE turn % 4 <> 3 END AS fits, 0.25 + CASE turn % 4 WHEN 1 THEN (conv_id % 7 - 3) / 10.0::DOUBLE WHEN 2 THEN (conv_id % 7 - 3) / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS delta FROM w),
 u AS (SELECT conv_id, turn, fits, delta, unnest(own) AS x, unnest(range(0, len(own))) AS i FROM d),
 s AS (SELECT *, ceil(length(x) / 2)::BIGINT AS n, unnest(range(0, ceil(length(x) / 2)::BIGINT)) AS k FROM u),
 t AS (SELECT conv_id, turn, fits, delta, i, k, floor((i * 0.5::DOUBLE + floor(50 / n) / 100 * k) * 100 + 0.5) / 100 AS a, floor((i * 0.5::DOUBLE + floor(50 / n) / 100 * (k + 1)) * 100 + 0.5) / 100 AS b FROM s),
 m AS (SELECT conv_id, turn, i, k, CASE WHEN fits = false THEN a ELSE greatest(0.0::DOUBLE, floor((a + delta) * 100 + 0.5) / 100) END AS a, CASE WHEN fits = false THEN b ELSE greatest(0.0::DOUBLE, floor((b + delta) * 100 + 0.5) / 100) END AS b FROM t)
 SELECT conv_id, turn AS place, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, k) - 1 AS unit, a AS start, b AS "end" FROM m""")
def edited_trees(spark: SparkSession, sf: str) -> DataFrame:
    """The sung units of lines after a shift of all and of single lines; the edits of every
    fourth line name another text and are refused."""
    lines = _trees(spark, sf)
    edits = lines.where("place % 4 <> 0").select("conv_id", "place", ((F.col("conv_id") % 7 - 3) / 10.0).alias("d"), F.when(F.col("place") % 4 == 3, "another text").otherwise(F.col("line.fullText")).alias("t"))
    moved = trees.edited(lines, edits, ["conv_id"], F.lit(0.25), strict=False)
    return moved.select("conv_id", "place", F.posexplode(trees.leaves(F.col("line"))).alias("unit", "x")).select("conv_id", "place", "unit", F.col("x.startTime").alias("start"), F.col("x.endTime").alias("end"))


@query(r"""WITH w AS (SELECT conv_id, turn, least(12, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS n FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
 s AS (SELECT *, CASE WHEN n * 0.5::DOUBLE > 3 AND n > 0 THEN 3 / (n * 0.5::DOUBLE) ELSE 1.0::DOUBLE END AS scale FROM w)
 SELECT conv_id, turn AS place, n AS words, CASE WHEN n = 0 THEN 10.0::DOUBLE ELSE floor((10 + 0 * scale) * 100 + 0.5) / 100 END AS start, floor((10 + n * 0.5::DOUBLE * scale) * 100 + 0.5) / 100 AS "end" FROM s""")
def squeezed_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Lines moved to 10 s and squeezed into three seconds if they are longer."""
    line = _trees(spark, sf).withColumn("line", trees.squeezed(F.col("line"), F.lit(10.0), F.lit(13.0)))
    return line.select("conv_id", "place", F.size("line.words").cast("long").alias("words"), F.col("line.startTime").alias("start"), F.col("line.endTime").alias("end"))


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as frames of its slot: twelve to a line, of which the first stand still
    and the later ones are wiped from the left, or from the right where the value says so."""
    s = _symbols(spark, sf).withColumn("line", F.floor(F.col("place") / 12)).withColumn("phase", (F.col("place") % 12).cast("int"))
    first, wiped = (F.col("line") % 4 * 30).cast("int"), F.greatest(F.lit(0), F.col("phase") - 4) * 6
    cells = F.sequence(first, first + 39)
    text = F.when(F.col("phase") < 1, F.transform(cells, lambda c: c + (F.col("cents") % 5).cast("int"))).otherwise(cells)
    right = F.col("cents") % 7 == 0
    bright = F.filter(cells, lambda c: F.when(right, c < first + 40 - wiped).otherwise(c >= first + wiped))
    return s.select(F.col("user_id").alias("slot"), F.col("place").alias("index"), text.alias("text"), bright.alias("bright"))


SLOT_RULE = slots.Rule(least=20, other=10, width=1000, left=8)


@query()
def slot_wipes(spark: SparkSession, sf: str) -> DataFrame:
    """When the lines in each user's slot begin to be wiped."""
    return slots.wipes(_frames(spark, sf), SLOT_RULE)


_SHEET = r"""CASE turn % 6 WHEN 0 THEN '[00:' || lpad((turn * 7 % 60)::VARCHAR, 2, '0') || '.5][01:00]' || body WHEN 1 THEN body WHEN 2 THEN '[00:09.00]' WHEN 3 THEN '@' || body WHEN 4 THEN left(body, 5) || '[00:1' || turn % 10 || ':25] ' || right(body, 5) || '[00:30.000]' ELSE '[ar:' || body END"""


@query(rf"""WITH b AS (SELECT conv_id, turn, trim(left(regexp_replace(coalesce(text, ''), '[\[\]\n\r]', ' ', 'g'), 40), ' ') AS body FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
 r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, body) AS line, {_SHEET} AS row FROM b),
 p AS (SELECT conv_id, line, trim(regexp_replace(row, '\[\d+:\d{{2}}([.:]\d{{1,3}})?\]', '', 'g'), ' ') AS original, row,
  regexp_extract_all(regexp_extract(row, '(\[\d+:\d{{2}}(?:[.:]\d{{1,3}})?\](?:\s*\[\d+:\d{{2}}(?:[.:]\d{{1,3}})?\])*)', 1), '\[(\d+:\d{{2}}(?:[.:]\d{{1,3}})?)\]', 1) AS stamps FROM r),
 k AS (SELECT conv_id, line, original, unnest(CASE WHEN len(stamps) = 0 THEN [''] ELSE stamps END) AS s FROM p WHERE original <> '' AND (len(stamps) > 0 OR NOT regexp_matches(row, '^\[\w+:|^@')))
 SELECT conv_id, line, CASE WHEN s <> '' THEN string_split(s, ':')[1]::DOUBLE * 60 + left(string_split(s, ':')[2], 2)::DOUBLE + CASE WHEN length(s) > 5 THEN s[7:]::DOUBLE / 10.0 ** length(s[7:]) ELSE 0 END END AS start, original FROM k""")
def sheet_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a conversation's sheet: repeated and inner stamps, tags, stamps alone."""
    body = F.trim(F.left(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\[\]\n\r]", " "), F.lit(40)))
    own = table(spark, sf, "conversations").where("conv_id is not null and turn is not null").select("conv_id", "turn", body.alias("body"))
    row = F.expr(_SHEET.replace("(turn * 7 % 60)::VARCHAR", "cast(turn * 7 % 60 as string)"))
    lines = F.array_sort(F.collect_list(F.struct("turn", "body", row.alias("row"))))
    sheet = own.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["row"]), "\n").alias("text"))
    return sheets.parse(sheet, "conv_id").select(F.col("key").alias("conv_id"), F.col("line").cast("long").alias("line"), "start", "original")


QUERIES, SQL = query.queries, query.sql
