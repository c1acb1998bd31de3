"""What is written held against what was heard: lines that nobody sings, and phrases that no line
has. Lines are (by, place, start, sound), what was heard is (by, n, start, end, sound).

Both meet by steps of time. Only what finds no counterpart there is held against the whole text
of its key, which is one value then; a key is a song, so that is a few thousand letters.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.operators import alignment
from chronotext.operators.folds import folded

#: Seconds around a line in which it may have been heard, and around what was heard
#: in which its line may begin; letters below which a line isn't judged.
HEARD_NEAR, LINES_NEAR, LEAST = 12.0, 15.0, 3
#: The shares from which a line was heard, a phrase is written, two are the same.
HEARD, WRITTEN, SAME = 0.5, 0.7, 0.6
STEP = 30.0


def _text(order: str, sound: str) -> Column:
    """The sounds of a group in order, as one text."""
    own = F.array_sort(F.collect_list(F.struct(F.col(order), F.coalesce(sound, F.lit("")).alias("s"))))
    return F.array_join(F.transform(own, lambda x: x["s"]), "")


def _covered(enough: float):
    """A share up to enough, for filters on its result: a deterministic one would be worked out in
    the filter and once more behind it."""
    return alignment.covered(enough).asNondeterministic()


def _whole(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    return rows.groupBy(*by).agg(_text(order, "sound").alias("whole"))


def _met(lines: DataFrame, heard: DataFrame, by: list[str], slack: float) -> DataFrame:
    """(by, place, line_sound, n, heard_sound) of lines that begin in what was heard or near it."""
    step = lambda t: F.floor(t / STEP)
    first, last = F.col("start") - slack, F.greatest("start", "end") + slack
    spans = heard.where("start is not null").select(*by, "n", F.col("sound").alias("heard_sound"), first.alias("first"), last.alias("last"), F.explode(F.sequence(step(first), step(last))).alias("step"))
    points = lines.where("start is not null").select(*by, "place", F.col("sound").alias("line_sound"), "start", step(F.col("start")).alias("step"))
    return points.join(spans, [*by, "step"]).where("start between first and last").select(*by, "place", "line_sound", "n", "heard_sound")


def unheard(lines: DataFrame, heard: DataFrame, by: list[str]) -> DataFrame:
    """(by, place, share) of lines of three letters or more of which less than half was heard, in
    order, near their time or anywhere in the song. Where nothing was heard every line counts."""
    covered = _covered(HEARD)
    near = _met(lines, heard, by, HEARD_NEAR).groupBy(*by, "place").agg(_text("n", "heard_sound").alias("near"))
    own = lines.where(F.length("sound") >= LEAST).select(*by, "place", "sound").join(near, [*by, "place"], "left")
    own = own.withColumn("share", covered("sound", F.coalesce("near", F.lit("")))).where(F.col("share") < HEARD).drop("near")
    anywhere = own.join(_whole(heard, by, "n"), by, "left")
    best = F.greatest("share", covered("sound", F.coalesce("whole", F.lit(""))))
    return anywhere.withColumn("share", best).where(F.col("share") < HEARD).select(*by, "place", "share")


class _Fresh:
    """Phrases unlike those kept before, since overlapping windows hear them twice."""

    def __init__(self):
        self.kept: list[tuple[str, Counter]] = []

    def take(self, row: tuple) -> list[tuple]:
        piece = row[2]
        own = Counter(piece)
        for old, letters in self.kept:
            # no more than the letters that both have can be covered
            both = (own & letters).total()
            if any(both / len(x) >= SAME and alignment.covered_in_order(x, y, SAME) >= SAME for x, y in ((piece, old), (old, piece))):
                return []
        self.kept.append((piece, own))
        return [row]

    def end(self) -> list[tuple]:
        return []


def unwritten(lines: DataFrame, heard: DataFrame, by: list[str], shortest: int) -> DataFrame:
    """(by, n, at, piece) of phrases, shortest letters or longer, that were heard but that neither
    the lines around nor the whole song have, each once.

    If a song's lines aren't all timed, or none is near, it is held against all of them. A key's
    phrases come in order of (n, at) to one task, which holds those that it kept."""
    stretches, covered = alignment.stretches(shortest), _covered(WRITTEN)
    near = _met(lines, heard, by, LINES_NEAR).groupBy(*by, "n").agg(_text("place", "line_sound").alias("near"))
    loose = lines.where("start is null").select(*by).distinct().withColumn("loose", F.lit(True))
    own = heard.where(F.length("sound") > shortest).select(*by, "n", "sound").join(near, [*by, "n"], "left").join(loose, by, "left")
    own = own.withColumn("near", F.when(F.col("loose").isNull() & (F.col("near") != ""), F.col("near"))).drop("loose")
    whole = _whole(lines, by, "place")
    some, none = own.where("near is not null"), own.where("near is null").drop("near").join(whole.withColumnRenamed("whole", "near"), by, "left").withColumn("near", F.coalesce("near", F.lit("")))
    found = some.unionByName(none).select(*by, "n", "sound", F.explode(stretches("sound", "near")).alias("x"))
    pieces = found.select(*by, "n", F.col("x.begin").alias("at"), F.expr("substring(sound, x.begin + 1, x.end - x.begin)").alias("piece"))
    new = pieces.join(whole, by, "left").where(covered("piece", F.coalesce("whole", F.lit(""))) < WRITTEN).select(*by, "n", "at", "piece")
    kind = f"n {heard.schema['n'].dataType.simpleString()}, at int, piece string"
    return folded(new, by, ["n", "at"], partial(_Fresh), kind)
