"""Timed lines as trees: words, their syllables, and the readings above these.

A line is a struct (fullText, translation, startTime, endTime, words), a word (text, startTime,
endTime, syllables), a syllable (text, startTime, endTime, ruby) and a reading (text, startTime,
endTime). One walk gives every time of a tree to a function; times that are null stay null, and
lists that are null or empty stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.functions.timecodes import half_up

_NODE = "text: string, startTime: double, endTime: double"
RUBY = f"struct<{_NODE}>"
SYLLABLE = f"struct<{_NODE}, ruby: array<{RUBY}>>"
WORD = f"struct<{_NODE}, syllables: array<{SYLLABLE}>>"
LINE = f"struct<fullText: string, translation: string, startTime: double, endTime: double, words: array<{WORD}>>"

Times = Callable[[Column], Column]


def _timed(node: Column, how: Times, *rest: Column, text: tuple[str, ...] = ("text",)) -> Column:
    own = lambda c: F.when(node[c].isNotNull(), how(node[c])).alias(c)
    return F.when(node.isNotNull(), F.struct(*[node[c].alias(c) for c in text], own("startTime"), own("endTime"), *rest))


def mapped(line: Column, how: Times) -> Column:
    """The line with how(t) instead of each time t in it."""
    ruby = lambda s: F.transform(s["ruby"], lambda r: _timed(r, how)).alias("ruby")
    syllables = lambda w: F.transform(w["syllables"], lambda s: _timed(s, how, ruby(s))).alias("syllables")
    words = F.transform(line["words"], lambda w: _timed(w, how, syllables(w))).alias("words")
    return _timed(line, how, words, text=("fullText", "translation"))


def shifted(line: Column, seconds: Column) -> Column:
    """Later by seconds, in hundredths, never before 0."""
    return mapped(line, lambda t: F.greatest(F.lit(0.0), half_up(t + seconds)))


def clamped(line: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """No time after high, then none before low."""
    low_of = (lambda t: t) if low is None else (lambda t: F.greatest(t, low))
    return mapped(line, lambda t: low_of(t if high is None else F.least(t, high)))


def squeezed(line: Column, begin: Column, limit: Column) -> Column:
    """Moved to begin, and all of it drawn together evenly if it would go on after limit."""
    length, room = line["endTime"] - line["startTime"], limit - begin
    scale = F.coalesce(F.when((length > room) & (length != 0), room / length), F.lit(1.0))
    return mapped(line, lambda t: half_up(begin + (t - line["startTime"]) * scale))


def spanned(line: Column) -> Column:
    """Times of parents from those of their children: a syllable's from its readings, a word's
    from its syllables, the line's from its words, which end no earlier than they begin."""
    some = lambda x: x.isNotNull() & (F.size(x) > 0)

    def over(node: Column, children: Column, own: str, text: tuple[str, ...] = ("text",)) -> Column:
        begin = F.when(some(children), F.get(children, F.lit(0))["startTime"]).otherwise(node["startTime"])
        last = F.get(children, F.size(children) - 1)["endTime"]
        end = F.when(some(children), F.greatest(last, begin) if own == "words" else last).otherwise(node["endTime"])
        return F.when(node.isNotNull(), F.struct(*[node[c].alias(c) for c in text], begin.alias("startTime"), end.alias("endTime"), children.alias(own)))

    words = F.transform(line["words"], lambda w: over(w, F.transform(w["syllables"], lambda s: over(s, s["ruby"], "ruby")), "syllables"))
    return over(line, words, "words", ("fullText", "translation"))


def leaves(line: Column) -> Column:
    """The units that are sung, in order: a syllable's readings, else the syllable, else the word."""
    none = F.array().cast(f"array<{RUBY}>")
    unit = lambda x: F.struct(*[x[c].alias(c) for c in ("text", "startTime", "endTime")])
    some = lambda x: x.isNotNull() & (F.size(x) > 0)
    of_syllable = lambda s: F.when(some(s["ruby"]), F.transform(s["ruby"], unit)).otherwise(F.array(unit(s)))
    of_word = lambda w: F.when(some(w["syllables"]), F.flatten(F.transform(w["syllables"], of_syllable))).otherwise(F.array(unit(w)))
    return F.coalesce(F.flatten(F.transform(line["words"], of_word)), none)


def edited(lines: DataFrame, edits: DataFrame, by: list[str], whole: Column, strict: bool = True) -> DataFrame:
    """lines (by, place, line) with each line later by whole and by its own edit (by, place, d, t),
    and ``moved``; null shifts are none.

    An edit names the text of the line that it was made for. If the line has another text now,
    strict fails with the line's place, else the line stays where it is and moved is null."""
    own = edits.select(*by, "place", F.col("d").alias("__d"), F.col("t").alias("__t"), F.lit(True).alias("__edited"))
    both = lines.join(own, [*by, "place"], "left")
    other = F.coalesce(F.col("__edited"), F.lit(False)) & ~F.col("__t").eqNullSafe(F.col("line.fullText"))
    delta = F.coalesce(whole, F.lit(0.0)) + F.coalesce("__d", F.lit(0.0))
    said = F.raise_error(F.concat(F.lit("the text has changed since the edit was made, in line "), F.col("place").cast("string"))).cast("boolean") if strict else F.lit(None).cast("boolean")
    # the check stands in the column that the line is made from, so it can't be left out as unused
    both = both.withColumn("moved", F.when(other, said).otherwise(delta != 0))
    line = F.when(F.col("moved"), shifted(F.col("line"), delta)).otherwise(F.col("line"))
    return both.withColumn("line", line).drop("__d", "__t", "__edited")
