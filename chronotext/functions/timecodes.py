"""Clock stamps of time-aligned text, and rounding as time-aligned formats want it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"(datediff({ts}, date'1970-01-01') * 86400L + hour({ts}) * 3600 + minute({ts}) * 60) * 1000000L + cast(extract(SECOND FROM {ts}) * 1000000 AS long)")


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounds half up on the scaled value: floor(x * 10^d + 0.5) / 10^d."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def ticks(seconds: Column) -> Column:
    """Hundredths of a second, not below 0."""
    return F.greatest(F.lit(0).cast("long"), F.floor(seconds * 100 + 0.5))


def stamp(seconds: Column, separator: str = ".") -> Column:
    """[mm:ss.cc], or with another separator [mm:ss:cc]."""
    t = ticks(seconds)
    return F.format_string(f"[%02d:%02d{separator}%02d]", F.floor(t / 6000), F.floor(t / 100) % 60, t % 100)


def seconds_of(text: Column) -> Column:
    """Seconds of the first stamp mm:ss with up to three digits after . or : (null if none)."""
    part = lambda i: F.regexp_extract(text, r"(\d+):(\d{1,2})(?:[.:](\d{1,3}))?", i)
    fraction = F.when(part(3) == "", F.lit(0.0)).otherwise(part(3).cast("double") / F.pow(F.lit(10.0), F.length(part(3))))
    return F.when(part(1) != "", part(1).cast("double") * 60 + part(2).cast("double") + fraction)


#: Fixed value: a stamp inside a row, hundredths after : or, in older files, after a point.
INNER = r"\[\d+:\d{2}[:.]\d{2,3}\]"


def timed_parts(text: Column, origin: float = 0.0, last_end: Column | None = None) -> Column:
    """The pieces (text, start, end) between stamps, in order and without empty ones.

    A piece runs from its stamp to the next one, what leads the first stamp from the origin on.
    After the last stamp a piece ends at last_end, or where it starts if that is null; a null
    text gives null, an empty one no pieces."""
    at = F.transform(F.regexp_extract_all(text, F.lit(f"({INNER})"), F.lit(1)), lambda s: seconds_of(s) + origin)
    starts = F.concat(F.array(F.lit(origin)), at)
    after = F.element_at(starts, -1) if last_end is None else F.coalesce(last_end, F.element_at(starts, -1))
    dealt = F.arrays_zip(F.split(text, INNER).alias("text"), starts.alias("start"), F.concat(at, F.array(after)).alias("end"))
    return F.filter(dealt, lambda p: p["text"] != "")


def tagged(parts: Column, last_end: Column) -> Column:
    """The row that ``timed_parts`` reads: [mm:ss:cc] before each piece (text, start), and one
    at the end. Rows whose pieces hold [ or ] give null, as they would be read differently."""
    row = F.concat(F.array_join(F.transform(parts, lambda p: F.concat(stamp(p["start"], ":"), p["text"])), ""), stamp(last_end, ":"))
    return F.when(~F.exists(parts, lambda p: p["text"].rlike(r"[\[\]]")), row)
