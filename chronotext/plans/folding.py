"""Queries by rules that go through a key's rows in order: pins, votes, windows, pairings.

A user's events are the symbols of a song: the n-th stands at place n and was heard around
frame 3 n, earlier or later by what its value says. Turns of a conversation are a lyric and
what was heard; their words are syllables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.functions import sounds, texts
from chronotext.operators import folds, framewise, pairing
from chronotext.plans.registry import Registry
from chronotext.sources.sheets import table

query = Registry()

_CENTS = "floor(value * 100 + 0.5)::BIGINT"
_PLACES = f"""o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, {_CENTS} AS cents FROM events),
s AS (SELECT user_id, place, 3 * place + cents % 23 - 11 AS frame, event_type = 'purchase' AND cents % 4 = 0 AS hand, event_type = 'error' AS twin, event_type <> 'view' AS pinned, cents FROM o)"""


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    cents = F.floor(F.col("value") * 100 + 0.5)
    o = table(spark, sf, "events").select("user_id", place.alias("place"), cents.alias("cents"), "event_type")
    frame = F.col("place") * 3 + F.col("cents") % 23 - 11
    return o.select("user_id", "place", frame.alias("frame"), ((F.col("event_type") == "purchase") & (F.col("cents") % 4 == 0)).alias("hand"), (F.col("event_type") == "error").alias("twin"), (F.col("event_type") != "view").alias("pinned"), "cents")


@query(f"""WITH RECURSIVE {_PLACES}, n AS (SELECT *, sum(twin::INT) OVER (PARTITION BY user_id ORDER BY place)::BIGINT AS same FROM s),
 p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS k FROM n WHERE pinned),
 w AS (SELECT user_id, k, place, frame, hand, true AS kept, place AS last_place, frame AS last_frame, same AS last_same FROM p WHERE k = 1
  UNION ALL SELECT p.user_id, p.k, p.place, p.frame, p.hand, p.hand OR p.frame - w.last_frame >= p.place - w.last_place + p.same - w.last_same,
   CASE WHEN p.hand OR p.frame - w.last_frame >= p.place - w.last_place + p.same - w.last_same THEN p.place ELSE w.last_place END,
   CASE WHEN p.hand OR p.frame - w.last_frame >= p.place - w.last_place + p.same - w.last_same THEN p.frame ELSE w.last_frame END,
   CASE WHEN p.hand OR p.frame - w.last_frame >= p.place - w.last_place + p.same - w.last_same THEN p.same ELSE w.last_same END FROM w JOIN p ON p.user_id = w.user_id AND p.k = w.k + 1)
 SELECT user_id, place, frame, hand, kept FROM w""")
def pins_with_room(spark: SparkSession, sf: str) -> DataFrame:
    """Which pins leave room for the symbols since the kept pin before them."""
    same = F.sum(F.col("twin").cast("int")).over(Window.partitionBy("user_id").orderBy("place"))
    pins = _symbols(spark, sf).withColumn("same", same).where("pinned")
    return folds.with_room(pins, ["user_id"]).select("user_id", "place", "frame", "hand", "kept")


@query(f"""WITH {_PLACES}, g AS (SELECT user_id, place // 7 AS line, list(frame ORDER BY place) AS own, min(place) AS first FROM s GROUP BY ALL),
 l AS (SELECT *, coalesce(lead(own[1]) OVER (PARTITION BY user_id ORDER BY line), own[len(own)] + 100) AS stop FROM g),
 t AS (SELECT *, len(own) > 1 AND stop - own[len(own)] < 10 AS tight, greatest(own[1] + 3 * (len(own) - 1), least(own[len(own)], stop - 10)) AS newest FROM l),
 m AS (SELECT *, CASE WHEN tight THEN list_reduce(list_prepend([newest], list_transform(list_reverse(own[2:len(own) - 1]), lambda x: [x])), lambda a, x: CASE WHEN len(a) > 0 AND a[1] IS NOT NULL AND x[1] > a[len(a)] - 3 AND NOT list_contains(a, -999999) THEN a || [a[len(a)] - 3] ELSE a || [-999999, x[1]] END) END AS back FROM t),
 f AS (SELECT *, CASE WHEN tight THEN [own[1]] || list_reverse(list_filter(back, lambda x: x <> -999999)) ELSE own END AS pushed FROM m)
 SELECT user_id, place, start, pushed FROM (SELECT user_id, unnest(range(first, first + len(own))) AS place, unnest(own) AS start, unnest(pushed) AS pushed FROM f)""")
def starts_pushed_back(spark: SparkSession, sf: str) -> DataFrame:
    """Starts of a line's units, moved so that its last one is shown for ten frames."""
    s = _symbols(spark, sf).select("user_id", F.floor(F.col("place") / 7).alias("line"), "place", F.col("frame").alias("start"), F.col("place").alias("unit"))
    first = s.groupBy("user_id", "line").agg(F.min_by("start", "unit").alias("first"), F.max_by("start", "unit").alias("last"))
    stop = F.coalesce(F.lead("first").over(Window.partitionBy("user_id").orderBy("line")), F.col("last") + 100)
    units = s.join(first.select("user_id", "line", stop.alias("stop")), ["user_id", "line"])
    return folds.pushed_back(units, ["user_id", "line"], 10, 3).select("user_id", "place", "start", "pushed")


@query()
def unjammed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows in which symbols begin after pins in the way have gone."""
    s = _symbols(spark, sf)
    rows = s.select("user_id", "place", (F.col("frame") - 20).alias("low"), (F.col("frame") + 20).alias("high"), F.when(F.col("pinned") & (F.col("frame") >= 0), F.col("frame")).alias("pin"), (F.col("cents") % 3).alias("slack"), F.col("twin").alias("same"), (F.col("hand") & (F.col("cents") % 3 == 0) & (F.col("frame") >= 0)).alias("hand"))
    return folds.unjammed(rows, ["user_id"])


@query()
def unit_votes(spark: SparkSession, sf: str) -> DataFrame:
    """What other readings make of each unit's anchor; a unit has two symbols."""
    return folds.voted(_readings(spark, sf), ["user_id"])


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    s = _symbols(spark, sf)
    heard = lambda k: F.when(F.floor(F.col("cents") / k) % 3 != 0, F.col("frame") + F.floor(F.col("cents") / k) % 31 - 15)
    both = F.array_compact(F.array(heard(7), heard(11)))
    leading = F.col("place") % 2 == 0
    return s.select("user_id", "place", F.floor(F.col("place") / 2).alias("unit"), leading.alias("leading"), F.when(F.col("pinned"), F.col("frame")).alias("anchor"), F.concat(both, F.array_compact(F.array(heard(13)))).alias("votes"), both.alias("second"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, lyric, heard): the words of a turn and of the next one."""
    own = table(spark, sf, "conversations").select("conv_id", "turn", texts.words(F.lower(F.coalesce("text", F.lit("")))).alias("lyric"))
    return own.withColumn("heard", F.lead("lyric").over(Window.partitionBy("conv_id").orderBy("turn"))).where("heard is not null")


def _windows(places: Column, others: Column) -> list[Column]:
    """(low, high, due, heard_at) of each place: ten frames a word, windows of 40 words around
    where a word would stand if both went at the same pace; every fifth word's time is unknown."""
    pace = lambda i: F.floor(i * F.size(others) / F.size(places)).cast("int")
    every = lambda x, f: F.transform(x, lambda _, i: f(i))
    return [every(places, lambda i: pace(i) - 20), every(places, lambda i: pace(i) + 20), every(places, lambda i: F.when(i % 5 == 4, -1).otherwise(pace(i) * 10)), every(others, lambda i: i * 10)]


@query()
def windowed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The partners of a turn's words in the next turn, gentle and steep in distance."""
    asked, args = _asked(spark, sf), ["lyric", "heard", *_windows(F.col("lyric"), F.col("heard"))]
    got = asked.select("conv_id", "turn", pairing.paired("gentle")(*args).alias("gentle"), pairing.paired("steep")(*args).alias("steep"))
    return got.select("conv_id", "turn", F.array_join("gentle", ",").alias("gentle"), F.array_join("steep", ",").alias("steep"))


@query()
def sound_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The partners of a turn's words in the next turn by their first sounds."""
    asked = _asked(spark, sf)
    heard = lambda c: F.transform(c, lambda x: F.struct(sounds.syllable_family(x).alias("family"), sounds.syllable_vowel(x).alias("vowel")))
    got = asked.select("conv_id", "turn", pairing.paired("sounds")(heard("lyric"), heard("heard"), *_windows(F.col("lyric"), F.col("heard"))).alias("p"))
    return got.select("conv_id", "turn", F.array_join("p", ",").alias("partners"))


_LETTERS = "regexp_replace(lower(x), '[^a-z]', '', 'g')"
_ONSET = f"regexp_extract({_LETTERS}, '^[^aiueo]*', 0)"


@query(rf"""WITH w AS (SELECT x, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS x FROM conversations) GROUP BY 1)
 SELECT x AS word, n, CASE WHEN left({_ONSET}, 2) IN ('ts', 'ch', 'sh') THEN 2 ELSE coalesce(map([{", ".join(f"'{k}'" for k in sounds.SYLLABLE_FAMILY)}], {list(sounds.SYLLABLE_FAMILY.values())})[left({_ONSET}, 1)], 0) END AS family,
  CASE WHEN regexp_matches({_LETTERS}, '[aiueo]') THEN strpos('aiueo', regexp_extract({_LETTERS}, '[aiueo]', 0)) - 1 ELSE 5 END::INT AS vowel FROM w""")
def word_sounds(spark: SparkSession, sf: str) -> DataFrame:
    """The family of the first consonant and the first vowel of each word."""
    words = table(spark, sf, "conversations").select(F.explode(texts.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.select("word", "n", sounds.syllable_family(F.col("word")).alias("family"), sounds.syllable_vowel(F.col("word")).alias("vowel"))


@query(r"""WITH c AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z'' ]')) AS letter, unnest(range(0, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z'' ]')))) AS place FROM conversations),
 a AS (SELECT *, place * 4 AS pos FROM c WHERE letter <> ' '),
 b AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 10 THEN lag(letter) OVER w ELSE '' END AS before FROM a WINDOW w AS (PARTITION BY conv_id, turn ORDER BY place)),
 f AS (SELECT *, CASE WHEN letter IN ('a', 'e', 'i', 'o', 'u') THEN 1 WHEN letter IN ('y', 'w', '''') OR letter = 'h' AND before IN ('s', 'z', 'c') OR letter = 'g' AND before = 'n' THEN 0 WHEN letter IN ('q', 'x') THEN 6
   WHEN contains('bpfv', letter) THEN 2 WHEN letter = 'm' THEN 3 WHEN letter = 'n' THEN 4 WHEN contains('lr', letter) THEN 5 WHEN contains('gk', letter) THEN 6 WHEN contains('szjc', letter) THEN 7 WHEN contains('dt', letter) THEN 8 WHEN letter = 'h' THEN 9 ELSE 10 END AS family FROM b),
 l AS (SELECT conv_id, turn, list_reduce(list([{'place': place, 'pos': pos, 'family': family}] ORDER BY place), lambda k, x: CASE WHEN x[1].family = k[len(k)].family AND x[1].pos - k[len(k)].pos <= 15 THEN k ELSE k || x END) AS kept FROM f WHERE family > 0 GROUP BY 1, 2)
 SELECT conv_id, turn, x.place AS place, x.pos AS "at", x.family AS family FROM (SELECT conv_id, turn, unnest(kept) AS x FROM l)""")
def letter_families(spark: SparkSession, sf: str) -> DataFrame:
    """The stream of sound families in each turn's letters, four frames a letter."""
    letters = F.posexplode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z' ]"), F.lit(0)))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", letters.alias("place", "letter")).where("letter <> ' '")
    return folds.family_stream(rows.withColumn("at", F.col("place") * 4), ["conv_id", "turn"])


@query()
def entered_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The words of a turn as frames, in which the first six letters that begin the next turn's
    words are placed; a letter must begin near where its word would stand at the same pace. A
    frame's score for a letter falls by how far its own first letter is from it."""
    asked = _asked(spark, sf).where("size(lyric) > 0").withColumn("frames", F.transform("lyric", lambda x: F.ascii(x) % 26))
    near = F.flatten(F.transform("frames", lambda c: F.concat(F.array(F.lit(-1.5)), F.transform(F.sequence(F.lit(0), F.lit(25)), lambda s: -F.abs(s - c) / 4.0))))
    symbols = F.transform(F.slice("heard", 1, 6), lambda x: F.ascii(x) % 26 + 1)
    pace = lambda off: F.transform("symbols", lambda _, k: (F.floor(k * F.size("lyric") / 6) + off).cast("int"))
    rows = asked.select("conv_id", "turn", "lyric", near.alias("scores"), symbols.alias("symbols"))
    starts = framewise.placed(27, rule="entered")("scores", "symbols", pace(-3), pace(6))
    return rows.select("conv_id", "turn", F.array_join("symbols", ",").alias("symbols"), F.array_join(starts, ",").alias("starts"))


QUERIES, SQL = query.queries, query.sql
