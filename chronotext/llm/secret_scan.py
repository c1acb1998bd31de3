"""Secret scans: known patterns, and windows of high entropy over candidate strings.

Patterns (assign, access, hex) are matched leftmost without overlap over whole texts. Then
for each character class the runs of its characters are candidates; a window of WINDOW
characters slides over a candidate, with a count of each character that is raised for the
character that enters and lowered for the one that leaves. The window's Shannon entropy
follows from the same two counts. Windows that reach the class's threshold are flagged and
joined to spans. Candidates on the allow list are left out, and placeholders within a text
are blanked first, so that a window over one is no candidate but what stands beside it is.

Only column functions are used and every row is worked on by itself: no shuffle, no Python.
A match's place is the sum of the lengths of matches and pieces before it; places are summed
up within chunks of CHUNK matches and over chunks, so that a text of n matches costs about
n * CHUNK + (n / CHUNK) ** 2 array copies and not n ** 2.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS_START, ACCESS_REST, HEX_RUN = "AKIA", "[A-Z0-9]", "[0-9a-f]"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

WINDOW = 20
#: kind -> (characters, least entropy of a window in bits). Random windows of 20 have about
#: 4.0 bits in the first class and 3.4 in the second; windows of words stay below 3.7.
CLASSES = {
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.8),
    "entropy_hex": ("0123456789abcdefABCDEF", 3.0),
}
#: Candidates that match one of these are no secrets: plain words, also joined by signs;
#: numbers; UUIDs. (Alphabets, counted-up digits and placeholders: see BLANKED.)
ALLOWED = (
    r"^[A-Z]?[a-z]+$|^[A-Z]+$",
    r"^[A-Z]?[a-z]+([-_/+=]+[A-Z]?[a-z]+)*$",
    r"^[0-9]+([-_/+=][0-9]+)*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
#: Parts of a text that are no part of a secret, whatever stands around them.
BLANKED = ("abcdefghijkl", "0123456789", "example", "placeholder", "changeme")
#: Matches whose places are summed up at once.
CHUNK = 128
#: Counts of a window are held BITS bits each, PACKED to a long.
BITS, PACKED = 5, 12
KINDS = ("assign", "access", "hex", *CLASSES)


def _class(characters: str) -> str:
    return "[" + characters.replace("-", r"\-") + "]"


def _running(parts: Column, zero: Column) -> Column:
    """Sums of parts before each of them."""
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(parts, F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])


def _sums_before(parts: Column) -> Column:
    """For each of an array's numbers the sum of all before it, chunk by chunk."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)
    n = F.size(parts)
    firsts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(firsts, lambda i: F.slice(parts, i, F.lit(CHUNK)))
    begins = _running(F.transform(chunks, total), F.lit(0))
    return F.flatten(F.transform(F.arrays_zip(chunks.alias("chunk"), begins.alias("begin")), lambda c: _running(c["chunk"], c["begin"])))


def _spans(text: Column, pattern: str, needed: Column, group: int = 0) -> Column:
    """Array of (start, stop, match, group) of all matches, if the text may have any."""
    none = F.array().cast("array<struct<start:int,stop:int,match:string,own:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.length)
    # between matches lie the gaps: place k is the sum of k + 1 gaps and k lengths of matches
    sums = _sums_before(F.zip_with(gaps, F.transform(found, F.length), lambda g, m: g + m))
    zipped = F.arrays_zip(found.alias("match"), own.alias("own"), gaps.alias("gap"), sums.alias("before"))
    start = lambda x: x["before"] + x["gap"]
    placed = F.transform(zipped, lambda x: F.struct(start(x).alias("start"), (start(x) + F.length(x["match"])).alias("stop"), x["match"].alias("match"), x["own"].alias("own")))
    return F.when(needed, placed).otherwise(none)


def blanked(text: Column) -> Column:
    """text with as many blanks in place of each part on the list."""
    for part in BLANKED:
        text = F.regexp_replace(text, F.lit(f"(?i){part}"), F.lit(" " * len(part)))
    return text


def _kinds(spans: Column, kind: str) -> Column:
    """spans (start, stop) as (start, order of kind, stop, kind)."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))


def _windows(candidate: Column, characters: str, least: float) -> Column:
    """Spans within a candidate's match that windows of entropy least and up cover."""
    w = WINDOW
    f = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(w + 2)])
    weight = lambda c: F.element_at(f, c + 1)
    text, at = candidate["match"], candidate["start"]
    none = F.array().cast("array<struct<start:int,stop:int>>")
    nowhere = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("stop"))
    words = -(-len(characters) // PACKED)
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("n"), F.lit(0.0).alias("sum"), none.alias("out"), nowhere.alias("open"))
    closed = lambda out, span: F.when(span["stop"] < 0, out).otherwise(F.concat(out, F.array(span)))
    # each character's number from 0, found once for the whole candidate
    numbers = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.call_function("locate", c, F.lit(characters)) - 1)
    bits = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), (x % PACKED * BITS).cast("int"))

    def count(n: Column, x: Column) -> Column:
        own = F.get(n, F.floor(x / PACKED).cast("int"))
        return F.call_function("shiftright", own, (x % PACKED * BITS).cast("int")).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def step(acc: Column, p: Column, own: Column) -> Column:
        leave = F.when(p > w, F.get(own, p - w - 1)).otherwise(F.lit(-1))
        moves = F.transform(F.array(F.struct(F.get(own, p - 1).alias("enter"), leave.alias("leave"))), lambda m: move(acc, p, m))
        return F.element_at(moves, 1)

    def move(acc: Column, p: Column, m: Column) -> Column:
        gone = F.when(m["leave"] >= 0, count(acc["n"], m["leave"])).otherwise(F.lit(1))
        come = count(acc["n"], m["enter"]) - (m["enter"] == m["leave"]).cast("int")
        total = acc["sum"] + weight(gone - 1) - weight(gone) + weight(come + 1) - weight(come)
        within = lambda i, x: F.when(F.floor(x / PACKED) == i, bits(x)).otherwise(F.lit(0).cast("long"))
        counts = F.transform(acc["n"], lambda c, i: c + within(i, m["enter"]) - F.when(m["leave"] >= 0, within(i, m["leave"])).otherwise(F.lit(0).cast("long")))
        return F.element_at(F.transform(F.array(total), lambda t: grown(acc, counts, p, t)), 1)

    def grown(acc: Column, counts: Column, p: Column, total: Column) -> Column:
        """A high window lengthens the open span, or closes it and opens another: arrays are
        copied once for each span, not for each character."""
        high = (p >= w) & (F.lit(math.log2(w)) - total / w >= least - 1e-9)
        start, stop, now = at + p - w, at + p, acc["open"]
        joins = now["stop"] >= start
        span = F.struct(F.when(joins, now["start"]).otherwise(start).alias("start"), stop.alias("stop"))
        out = F.when(high & ~joins, closed(acc["out"], now)).otherwise(acc["out"])
        return F.struct(counts.alias("n"), total.alias("sum"), out.alias("out"), F.when(high, span).otherwise(now).alias("open"))

    slide = lambda own: F.aggregate(F.sequence(F.lit(1), F.size(own)), zero, lambda acc, p: step(acc, p, own), lambda acc: closed(acc["out"], acc["open"]))
    return F.element_at(F.transform(F.array(numbers), slide), 1)


def _flagged(candidates: Column, characters: str, least: float) -> Column:
    return F.flatten(F.transform(candidates, lambda c: _windows(c, characters, least)))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _allowed(text: Column) -> Column:
    hit = F.lit(False)
    for pattern in ALLOWED:
        hit = hit | text.rlike(pattern)
    return hit


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id_col, base and added, arrays of (start, stop, kind) in
    code points, stop exclusive, by start and kind.

    base holds the matches of the three patterns that are long enough, added the spans of
    high entropy; they may overlap. A candidate of any length is looked at whole, at a cost that
    grows with its length. A null or empty text has neither. Rows are independent,
    so repeated and null ids are kept as they are. An empty table gives no rows."""
    text = F.col("text")
    low = F.lower(text)
    words = F.lit(False)
    for word in ASSIGN_WORDS:
        words = words | low.contains(word)
    assign = F.filter(_spans(text, ASSIGN, words, 2), lambda s: F.length(s["own"]) >= LEAST_ASSIGN)
    # runs are greedy and a run's first match takes the rest of it, so length can be in the pattern
    access = _spans(text, rf"{ACCESS_START}{ACCESS_REST}{{{LEAST_ACCESS - 4},}}", text.contains(ACCESS_START))
    hexes = _spans(text, rf"{HEX_RUN}{{{LEAST_HEX},}}", text.rlike(rf"{HEX_RUN}{{{LEAST_HEX}}}"))
    rows = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text")).withColumn("bare", blanked(text))
    cols = {"assign": assign, "access": access, "hex": hexes}
    for kind, (characters, least) in CLASSES.items():
        run = _class(characters)
        runs = _spans(F.col("bare"), rf"{run}{{{WINDOW},}}", F.col("bare").rlike(rf"{run}{{{WINDOW}}}"))
        cols[kind] = F.filter(runs, lambda s: ~_allowed(s["match"]))
    rows = rows.select("id", *[c.alias(k) for k, c in cols.items()])
    base = F.array_sort(F.concat(*[_kinds(F.col(k), k) for k in ("assign", "access", "hex")]))
    added = F.array_sort(F.concat(*[_kinds(_flagged(F.col(k), *CLASSES[k]), k) for k in CLASSES]))
    return rows.select(F.col("id").alias(id_col), base.alias("base"), added.alias("added"))


def written_as(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
