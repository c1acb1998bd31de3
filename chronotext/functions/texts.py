"""Lines, words and word n-grams of texts as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lines(text: Column) -> Column:
    """Trimmed lines that are not blank, in order."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def grams(items: Column, n: int) -> Column:
    """Distinct runs of n items, joined by a space; none if there are fewer items. items should be
    a column of its own, as an expression would be worked out for each run."""
    last = F.size(items) - n
    # single items, as slice would copy all of them for each run
    own = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *[F.get(items, i + k) for k in range(n)])))
    return F.array_distinct(F.coalesce(own, F.array().cast("array<string>")))


def plain_html(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags gone, white space squeezed."""
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(F.regexp_replace(html, r"[ \t\n\r]+", " "))
