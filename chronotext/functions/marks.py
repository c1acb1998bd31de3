"""Readings written into a text: ``{base|reading}``, and ``base(reading)`` as authors write it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an opened base and a plain one may hold, and what a reading may.
OPENED, SIGNS, READING = "[^｜(（)）]+", "[㐀-鿿々○×]+", "[a-zA-Zぁ-ヿ]+"
MARK = r"\{([^{}|]+)\|([^{}]*)\}"


def bracketed(text: Column) -> Column:
    """base(reading) as {base|reading}: a base is a run of signs, or whatever follows the bar ｜."""
    return F.regexp_replace(text, f"(?:｜({OPENED})|({SIGNS}))[(（]({READING})[)）]", r"{$1$2|$3}")


def trimmed(text: Column) -> Column:
    """The kana that a marked base and its reading both end with moved behind the mark; only if
    that is the base's whole ending and leaves something of the base."""
    return F.regexp_replace(text, r"\{([^{}|]*[^{}|ぁ-ゖ])([ぁ-ゖ]+)\|([^{}|]*)\2\}", r"{$1|$3}$2")


def bare(text: Column) -> Column:
    """The text alone."""
    return F.regexp_replace(text, MARK, "$1")


def read(text: Column) -> Column:
    """The text as it is read."""
    return F.regexp_replace(text, MARK, "$2")
