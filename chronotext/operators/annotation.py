"""Timed lines (``trees.LINE``) with readings: put on by a song's rules, or built from units.

A rule (rank, base, reading, begin, until) names a text and the time in which it is read so; its
reading may hold stamps that count from the base's start. A song of up to 64 lines is held with its
rules; a longer one's lines are dealt in parts, in order of time, and the rules that reach a part's
time stream before its lines through one task. There lines meet rules by the text and by steps of
time, so they don't meet in pairs.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from math import floor
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from chronotext.functions import trees

STAMP = r"\[(\d+):(\d{2})[:.](\d{2,3})\]"
#: Seconds by which a start may miss a rule's time (fixed value), and the steps by which both meet.
SLACK, STEP = 0.001, 30.0
#: Lines of a part of a song, which share a copy of its rules, and lines that a task holds as Python's values.
PART, AT_ONCE = 64, 64


def parts(reading: str, begin: float, end: float | None) -> list[dict]:
    """The timed pieces of a reading; the last one ends with its base."""
    cut = re.split(STAMP, reading)
    at = [begin + int(m) * 60 + int(s) + float(f"0.{c}") for m, s, c in zip(cut[1::4], cut[2::4], cut[3::4])]
    ends = [*at, ([begin, *at][-1] if end is None else end)]
    return [{"text": t, "startTime": a, "endTime": b} for t, a, b in zip(cut[::4], [begin, *at], ends) if t]


def _units(word: dict) -> list[dict]:
    return word["syllables"] or [{**{c: word[c] for c in ("text", "startTime", "endTime")}, "ruby": None}]


def _parted(units: list[dict], at: int) -> list[dict]:
    """units with a border at this character; time runs evenly within a unit."""
    out, n = [], 0
    for u in units:
        k, size = at - n, len(u["text"])
        if 0 < k < size:
            middle = u["startTime"] + (u["endTime"] - u["startTime"]) * k / size
            out += [{**u, "text": u["text"][:k], "endTime": middle}, {**u, "text": u["text"][k:], "startTime": middle}]
        else:
            out.append(u)
        n += size
    return out


def _reach_inside(words: list[dict], base: str, reading: str, begin: float, until: float) -> list[dict]:
    """words with the rule's reading over each occurrence of its base that isn't a word itself,
    touches no reading and is sung in the rule's time."""
    text = "".join(w["text"] for w in words)
    at = text.find(base)
    while at >= 0:
        stop = at + len(base)
        edges = [0, *accumulate(len(w["text"]) for w in words)]
        first, last = bisect_right(edges, at) - 1, bisect_left(edges, stop) - 1
        touched = words[first : last + 1]
        units = [u for w in touched for u in _units(w)]
        borders = [edges[first], *(edges[first] + n for n in accumulate(len(u["text"]) for u in units))]
        under = [i for i, (a, b) in enumerate(zip(borders, borders[1:])) if a < stop and b > at]
        whole = first == last and edges[first] == at and edges[last + 1] == stop
        known = all(units[i][c] is not None and not units[i]["ruby"] for i in under for c in ("startTime", "endTime"))
        if not whole and known:
            head = units[under[0]]
            latest = head["endTime"] if borders[under[0]] < at else head["startTime"]
            if latest >= begin - SLACK and head["startTime"] <= until + SLACK:
                units = _parted(_parted(units, at - edges[first]), stop - edges[first])
                begins = [edges[first], *(edges[first] + n for n in accumulate(len(u["text"]) for u in units))]
                inner = [u for u, b in zip(units, begins) if at <= b < stop and u["text"]]
                ruby = parts(reading, inner[0]["startTime"], inner[-1]["endTime"])
                target = {"text": base, "startTime": inner[0]["startTime"], "endTime": inner[-1]["endTime"], "ruby": ruby}
                before = [u for u, b in zip(units, begins) if b < at or b == at and not u["text"]]
                after = [u for u, b in zip(units, begins) if b >= stop]
                joined = {"text": "".join(w["text"] for w in touched), "startTime": touched[0]["startTime"], "endTime": touched[-1]["endTime"], "syllables": [*before, target, *after]}
                words = [*words[:first], joined, *words[last + 1 :]]
        at = text.find(base, stop)
    return words


class _Even:
    """Words that take readings inside them or across them, by places in the text: nothing but what
    a reading touches is looked at for it. The same as ``_reach_inside`` where ``of`` holds."""

    @staticmethod
    def of(words: list[dict]) -> bool:
        """Whether no text is empty and each word's units are its text."""
        return all(w["text"] and (not w["syllables"] or (all(u["text"] for u in w["syllables"]) and sum(len(u["text"]) for u in w["syllables"]) == len(w["text"]))) for w in words)

    def __init__(self, words: list[dict]) -> None:
        self.text = "".join(w["text"] for w in words)
        size = len(self.text)
        # 1 where a word begins, where a unit begins, and where no reading may come any more
        self.edges, self.borders, self.closed = bytearray(size + 1), bytearray(size + 1), bytearray(size)
        self.edges[size] = self.borders[size] = 1
        # by their first place; a word with its end, as it may take others in, and whether it has
        self.words, self.units, self.joined = [None] * size, [None] * size, bytearray(size)
        self.forward, n = True, 0
        for w in words:
            self.edges[n], self.words[n] = 1, (w, w["endTime"])
            for u in _units(w):
                self.borders[n], self.units[n], k = 1, u, len(u["text"])
                if u["startTime"] is None or u["endTime"] is None or u["ruby"]:
                    self.closed[n : n + k] = b"\1" * k
                elif u["startTime"] > u["endTime"]:
                    self.forward = False
                n += k

    def put(self, base: str, reading: str, begin: float, until: float) -> None:
        text, edges, borders, closed, units = self.text, self.edges, self.borders, self.closed, self.units
        low, high, size = begin - SLACK, until + SLACK, len(base)
        at = text.find(base)
        while at >= 0:
            stop = at + size
            if closed.find(1, at, stop) < 0:
                a = borders.rfind(1, 0, at + 1)
                head = units[a]
                if head["startTime"] <= high and (head["endTime"] if a < at else head["startTime"]) >= low:
                    first, last, end = edges.rfind(1, 0, at + 1), edges.rfind(1, 0, stop), edges.find(1, stop)
                    if first < at or end > stop or first < last:
                        z, b = borders.rfind(1, 0, stop), borders.find(1, stop)
                        tail = units[z]
                        start = head["startTime"]
                        if a < at:
                            start += (head["endTime"] - start) * (at - a) / len(head["text"])
                            units[a] = {**head, "text": text[a:at], "endTime": start}
                            if z == a:
                                tail, z = {**head, "text": text[at:b], "startTime": start}, at
                        until_ = tail["endTime"]
                        if b > stop:
                            until_ = tail["startTime"] + (until_ - tail["startTime"]) * (stop - z) / (b - z)
                            units[stop] = {**tail, "text": text[stop:b], "startTime": until_}
                            borders[stop] = 1
                        borders[at:stop] = b"\1" + bytes(size - 1)
                        ruby = parts(reading, start, until_) if "[" in reading else [{"text": reading, "startTime": start, "endTime": until_}]
                        units[at] = {"text": base, "startTime": start, "endTime": until_, "ruby": ruby}
                        closed[at:stop] = b"\1" * size
                        self.words[first], self.joined[first] = (self.words[first][0], self.words[last][1]), 1
                        edges[first + 1 : end] = bytes(end - first - 1)
            at = text.find(base, stop)

    def done(self) -> list[dict]:
        out, n, size = [], 0, len(self.text)
        while n < size:
            end = self.edges.find(1, n + 1)
            w, until = self.words[n]
            if self.joined[n]:
                own = [u for u, b in zip(self.units[n:end], self.borders[n:end]) if b]
                w = {"text": self.text[n:end], "startTime": w["startTime"], "endTime": until, "syllables": own}
            out.append(w)
            n = end
        return out


class _Rules:
    """A song's rules as a part of its lines needs them: by size and text, those of a short time also
    by steps of time."""

    def __init__(self) -> None:
        self.spent, self.ever, self.near = set(), {}, {}

    def add(self, rank, base: str, reading: str, begin: float, until: float, sung: bool) -> None:
        found = [self.ever]
        if until - begin <= 4 * STEP:
            found = [self.near.setdefault(k, {}) for k in range(floor((begin - SLACK) / STEP), floor((max(begin, until) + SLACK) / STEP) + 1)]
        rule = (reading, begin, until, sung and rank not in self.spent)
        for x in found:
            x.setdefault(len(base), {}).setdefault(base, {}).setdefault(rule, []).append(rank)

    @classmethod
    def of(cls, rules: list[tuple], lines: list[dict | None]) -> _Rules:
        """A whole song's; those of a moment that find their word in its lines are spent."""
        self, rules = cls(), sorted(rules, key=lambda r: r[0])
        if moments := [r for r in rules if r[5] and r[4] - r[3] < SLACK]:
            starts: dict[str, list[float]] = {}
            for w in (w for x in lines if x for w in x["words"] or []):
                if w["startTime"] is not None:
                    starts.setdefault(w["text"], []).append(w["startTime"])
            self.spent.update(r[0] for r in moments if any(r[3] - SLACK <= t <= r[4] + SLACK for t in starts.get(r[1], [])))
        for r in rules:
            self.add(*r)
        return self

    def read(self, lines: list[dict | None]) -> list[dict | None]:
        return [self.over(x) if x and x["words"] and (self.ever or self.near) else x for x in lines]

    def over(self, line: dict) -> dict:
        """The line with readings over whole words (none takes a word's readings away), then those inside
        words or across them, longest base first."""
        words = line["words"]
        starts = [w["startTime"] for w in words if w["startTime"] is not None]
        if not starts:
            return line
        first = min(starts)
        last = max([first, *(w["endTime"] for w in words if w["endTime"] is not None)])
        low, high = (first - SLACK) / STEP, (max([last, *starts]) + SLACK) / STEP
        near = [self.ever, *(x for k, x in self.near.items() if low < k + 1 and k <= high)]
        words, whole = list(words), 0
        for n, w in enumerate(words):
            t, start, top = w["text"], w["startTime"], None
            if t and start is not None:
                for x in near:
                    for (reading, begin, until, _), ranks in x.get(len(t), {}).get(t, {}).items():
                        if begin - SLACK <= start <= until + SLACK and (top is None or top[0] < ranks[-1]):
                            top = ranks[-1], reading
            if top:
                whole += 1
                ruby = parts(top[1], start, w["endTime"]) if top[1] else None
                words[n] = {**w, "syllables": [{**{c: w[c] for c in ("text", "startTime", "endTime")}, "ruby": ruby}] if ruby else None}
        text = "".join(w["text"] or "" for w in words)
        inside = {}
        for x in near:
            for size, own in x.items():
                # whichever is less: the texts of this size in the line, or those that rules have
                bases = [b for b in own if b in text] if len(own) < len(text) else own.keys() & {text[i : i + size] for i in range(len(text) - size + 1)}
                for base in bases:
                    for (reading, begin, until, free), ranks in own[base].items():
                        if free and first <= until + SLACK and last >= begin - SLACK:
                            inside[base, reading, begin, until] = ranks
        if inside:
            even = _Even(words) if _Even.of(words) else None
            # a rule that was not put on somewhere isn't put on there when it comes again, if time goes on
            once = even and even.forward
            for _, _, rule in sorted((-len(rule[0]), rank, rule) for rule, ranks in inside.items() for rank in (ranks[:1] if once else ranks)):
                if even:
                    even.put(*rule)
                else:
                    words = _reach_inside(words, *rule)
            words = even.done() if even else words
        return {**line, "words": words} if whole or inside else line


def _values(x: pa.Array) -> list:
    """to_pylist, in much less time for texts, and for numbers without nulls."""
    plain = pa.types.is_string(x.type) or (x.null_count == 0 and pa.types.is_floating(x.type))
    return [None] * len(x) if x.null_count == len(x) else x.to_numpy(zero_copy_only=False).tolist() if plain else x.to_pylist()


def _lines(lines: pa.StructArray) -> list[dict | None]:
    """to_pylist, by columns."""
    words = lines.field("words")
    each = words.flatten()
    if each.null_count or lines.null_count:
        return lines.to_pylist()
    every = [{"text": t, "startTime": a, "endTime": b, "syllables": s} for t, a, b, s in zip(*[_values(each.field(c)) for c in ("text", "startTime", "endTime", "syllables")])]
    ends = list(accumulate(words.value_lengths().fill_null(0).to_pylist()))
    own = [every[a:b] if known else None for a, b, known in zip([0, *ends], ends, words.is_valid().to_pylist())]
    rest = [f.name for f in lines.type if f.name != "words"]
    return [dict(zip((*rest, "words"), x)) for x in zip(*[_values(lines.field(c)) for c in rest], own)]


def _steps(begin: Column, end: Column) -> Column:
    return F.sequence(F.floor((begin - SLACK) / STEP), F.floor((end + SLACK) / STEP))


def annotated(lines: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """lines (by, place, line) with the readings of rules (by, rank, base, reading, begin, until).

    Of rules for one whole word the one of highest rank counts; without a reading it takes the
    word's readings away. Then bases are looked for inside and across words. A rule for a single
    moment that has found its word there is spent: it must not go on to another text at that
    time. Without begin a rule holds from 0, without until for ever. Lines of a null key, without
    words or without rules stay as they are; rules without a base do nothing. Lines' other
    columns stay; (by, place) tells lines apart, (by, rank) rules."""
    if taken := {"_part", "_from", "_to", "_kind", "_rank", "_base", "_reading", "_begin", "_until", "_sung"} & set(lines.columns):
        raise ValueError(f"lines have columns named {sorted(taken)}")
    ever = F.lit(float("inf"))
    sung = F.regexp_replace(F.coalesce("reading", F.lit("")), STAMP, "") != ""
    r = rules.where("base <> ''").select(*by, F.col("rank").alias("_rank"), F.col("base").alias("_base"), F.coalesce("reading", F.lit("")).alias("_reading"), F.coalesce(F.col("begin").cast("double"), F.lit(0.0)).alias("_begin"), F.coalesce(F.col("until").cast("double"), ever).alias("_until"), sung.alias("_sung"))
    r = r.where("_sung or _reading = ''")

    known = reduce(and_, [F.col(c).isNotNull() for c in by])
    r, sheet = r.where(known), lines.where(known)

    # All sides grow with the songs, so none goes through the driver. Songs of one part are met where their
    # lines lie; the lines of longer ones are dealt in order of time by parts, each with the rules of its time.
    times = lambda c, f: f(F.transform("line.words", lambda w: w[c]))
    own = sheet.withColumn("_from", times("startTime", F.array_min)).withColumn("_to", F.greatest("_from", times("startTime", F.array_max), times("endTime", F.array_max)))
    number = F.row_number().over(Window.partitionBy(*by).orderBy("_from", "_to")) - 1
    long = own.select(*by, "_from", "_to").withColumn("_number", number).where(F.col("_number") == PART).select(*by).hint("shuffle_hash")
    short, r_short = sheet.join(long, by, "left_anti"), r.join(long, by, "left_anti")
    own, r = own.join(long, by, "left_semi").withColumn("_part", F.floor(number / PART)), r.join(long, by, "left_semi")
    spans = own.groupBy(*by, "_part").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    met = spans.join(r.hint("merge"), by).where((F.col("_from") <= F.greatest("_begin", "_until") + SLACK) & (F.col("_to") >= F.col("_begin") - SLACK))

    # what is spent for a whole song; only songs with rules of a moment have their words looked up
    moments = r.where(F.col("_sung") & (F.col("_until") - F.col("_begin") < SLACK)).withColumn("step", F.explode(_steps(F.col("_begin"), F.greatest("_begin", "_until"))))
    words = sheet.select(*by, "line").join(moments.select(*by).distinct().hint("shuffle_hash"), by, "left_semi").select(*by, F.explode("line.words").alias("w")).select(*by, F.col("w.text").alias("_base"), F.col("w.startTime").alias("start"))
    words = words.where("start is not null").withColumn("step", F.explode(_steps(F.col("start"), F.col("start"))))
    spent = words.join(moments.hint("merge"), [*by, "_base", "step"]).where((F.col("start") >= F.col("_begin") - SLACK) & (F.col("start") <= F.col("_until") + SLACK)).select(*by, "_rank").distinct()

    kind = lambda df, k: df.drop("_from", "_to").withColumn("_kind", F.lit(k))
    every = kind(own, 3)
    for k, df in enumerate((spans, spans.join(spent.hint("merge"), by), met)):
        every = every.unionByName(kind(df, k), allowMissingColumns=True)
    arrow, at = to_arrow_schema(lines.schema), lines.columns.index("line")

    def whole(song: pa.Table, rules: pa.Table) -> pa.Table:
        rows = list(zip(*[_values(rules.column(c).combine_chunks()) for c in ("_rank", "_base", "_reading", "_begin", "_until", "_sung")]))
        texts = _lines(song.column("line").combine_chunks()) if len(song) else []
        done = _Rules.of(rows, texts).read(texts) if rows and texts else texts
        return pa.Table.from_arrays([pa.array(done, f.type) if k == at else song.column(f.name).cast(f.type) for k, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        song, rows, done = _Rules(), [], []

        def flush(batch: pa.RecordBatch) -> pa.RecordBatch:
            some = batch.take(pa.array(rows))
            columns = [pa.array(done, f.type) if k == at else some.column(f.name).cast(f.type) for k, f in enumerate(arrow)]
            rows.clear(), done.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            rules = list(zip(*[_values(batch.column(c)) for c in ("_rank", "_base", "_reading", "_begin", "_until", "_sung")]))
            kinds, line = batch.column("_kind").to_numpy(), batch.column("line")
            # where another kind begins, and where a task has as many lines as it holds
            cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
            for a, b in ((x, min(x + AT_ONCE, z)) for y, z in zip(cuts, cuts[1:]) for x in range(y, z, AT_ONCE)):
                if kinds[a] == 3:
                    rows += range(a, b)
                    done += song.read(_lines(line.slice(a, b - a)))
                    if len(done) >= AT_ONCE:
                        yield flush(batch)
                elif kinds[a] == 2:
                    for rule in rules[a:b]:
                        song.add(*rule)
                elif kinds[a] == 1:
                    song.spent.update(rule[0] for rule in rules[a:b])
                else:
                    song = _Rules()
            if done:
                yield flush(batch)

    longer = every.repartition(*by, "_part").sortWithinPartitions(*by, "_part", "_kind", "_rank").mapInArrow(run, lines.schema)
    # under other names, as both may come from one table
    keys = {c: f"_key{k}" for k, c in enumerate(by)}
    shorter = short.groupBy(*by).cogroup(r_short.withColumnsRenamed(keys).groupBy(*keys.values())).applyInArrow(whole, lines.schema)
    return lines.where(~known).union(shorter).union(longer)


def built(units: DataFrame, by: list[str]) -> DataFrame:
    """(by, line, problem) from units (by, n, sung, orig, reading, start, end, expected) in order n.

    A unit with a reading (not null) begins a word, or goes on with the readings of the one
    before if its orig is empty; one that is sung without a reading is a word; any other text is
    joined to the word before it, or to the first one. Without line but with a problem: readings
    that go on after none, nothing sung, and a text other than expected (null: not compared)."""
    order = Window.partitionBy(*by).orderBy("n")
    orig = F.coalesce("orig", F.lit(""))
    marked, more = F.col("reading").isNotNull(), F.col("reading").isNotNull() & (orig == "")
    begins = (marked & ~more) | (~marked & F.coalesce("sung", F.lit(False)))
    u = units.select(*by, "n", orig.alias("orig"), "reading", F.col("start").cast("double").alias("startTime"), F.col("end").cast("double").alias("endTime"), "expected", begins.alias("begins"), marked.alias("marked"), (more & ~F.coalesce(F.lag(marked).over(order), F.lit(False))).alias("orphan"))
    u = u.withColumn("k", F.greatest(F.sum(F.col("begins").cast("int")).over(order), F.lit(1)))
    timed = F.col("begins") | F.col("marked")
    own = lambda flag, *columns: F.array_sort(F.collect_list(F.when(flag, F.struct("n", *columns))))
    words = u.groupBy(*by, "k").agg(
        own(F.lit(True), "orig").alias("text"), own(F.col("marked"), F.col("reading").alias("text"), "startTime", "endTime").alias("ruby"), F.max(F.when(F.col("marked") & F.col("begins"), F.col("orig"))).alias("base"),
        F.min_by("startTime", F.when(timed, F.col("n"))).alias("startTime"), F.max_by("endTime", F.when(timed, F.col("n"))).alias("endTime"), F.bool_or("orphan").alias("orphan"), F.bool_or("begins").alias("some"), F.max("expected").alias("expected"))
    ruby = F.transform("ruby", lambda x: F.struct(x["text"].alias("text"), x["startTime"].alias("startTime"), x["endTime"].alias("endTime")))
    syllables = F.when(F.size("ruby") > 0, F.array(F.struct(F.col("base").alias("text"), "startTime", "endTime", ruby.alias("ruby"))))
    word = F.struct("k", F.array_join(F.transform("text", lambda x: x["orig"]), "").alias("text"), "startTime", "endTime", syllables.alias("syllables"))
    lines = words.groupBy(*by).agg(F.array_sort(F.collect_list(word)).alias("words"), F.bool_or("orphan").alias("orphan"), F.bool_or("some").alias("some"), F.max("expected").alias("expected"))
    full = F.array_join(F.transform("words", lambda w: w["text"]), "")
    problem = F.when(F.col("orphan"), "readings go on after none").when(~F.col("some"), "nothing is sung").when(F.col("expected") != full, "the text has changed")
    plain = F.transform("words", lambda w: F.struct(*[w[c].alias(c) for c in ("text", "startTime", "endTime", "syllables")]))
    line = F.struct(full.alias("fullText"), F.lit(None).cast("string").alias("translation"), F.get("words", F.lit(0))["startTime"].alias("startTime"), F.get("words", F.size("words") - 1)["endTime"].alias("endTime"), plain.alias("words")).cast(trees.LINE)
    return lines.select(*by, F.when(problem.isNull(), line).alias("line"), problem.alias("problem"))
