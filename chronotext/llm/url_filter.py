"""URL filter: rules by host and path, and for the rest a character language-model ratio.

The urls that rules decide are the examples: those allowed train one variable-order Markov
model of characters, those blocked another. A context of up to ORDER characters is used if its
class has seen it LEAST_SEEN times; the estimate of the next character is mixed with that of
the context without its first character (by the number of different characters seen after it)
and falls back on it entirely for other contexts. A url's score is the difference of both
log-likelihoods divided by its number of symbols, and the threshold is calibrated on examples
that are kept from training.

The models are tables of counts, gathered from all examples and as large as these make them:
they are joined, not shipped to tasks. A symbol of a url is a row (url, last ORDER + 1
characters) whose log ratio comes from the table of different such grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, heavy

ORDER, LEAST_SEEN = 5, 2
#: Before and after a url's characters.
START, END = "\x02", "\x03"
#: Log ratios are added up in millionths, so that sums do not depend on their order.
UNIT = 1_000_000
#: Scores are compared in thousandths; those beyond the bound count as the bound.
FARTHEST = 20_000
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """The host in lower case, empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest of rules, (verdict, host and path), that fits: its
    host is the url's or a parent of it, and the url's path starts with its path. Null if
    none fits; of equal rules the first counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def kept_from_training(url: Column) -> Column:
    """An eighth of all urls, by hash."""
    return F.substring(F.md5(url), 1, 1).isin("0", "1")


def _grams(url: Column) -> Column:
    """For each character of url and its end, the last ORDER + 1 symbols."""
    symbols = F.regexp_extract_all(F.concat(F.lit(START * ORDER), url, F.lit(END)), F.lit("(?s)."), F.lit(0))
    cut = lambda s: F.transform(F.sequence(F.lit(1), F.size(s) - ORDER), lambda i: F.array_join(F.slice(s, i, ORDER + 1), ""))
    return F.element_at(F.transform(F.array(symbols), cut), 1)  # the symbols are found once, not for each place


def _endings(gram: str = "gram") -> Column:
    """The last 1 to ORDER + 1 symbols of a gram."""
    return F.explode(F.array(*[F.right(F.col(gram), F.lit(k)) for k in range(1, ORDER + 2)]))


def counted(examples: DataFrame) -> DataFrame:
    """(gram, a, b): how often allowed and blocked examples (url, allow) have each gram of 1
    to ORDER + 1 symbols. The longest are counted first; shorter ones are sums over them."""
    longest = examples.select(F.explode(_grams(F.col("url"))).alias("gram"), F.col("allow").cast("long").alias("a"))
    longest = longest.groupBy("gram").agg(F.sum("a").alias("a"), F.count(F.lit(1)).alias("n"))
    return longest.select(_endings().alias("gram"), "a", (F.col("n") - F.col("a")).alias("b")).groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def log_ratios(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, ratio): of each of grams, which are distinct, the log of its last symbol's
    probability after the others among allowed urls less that among blocked ones, in units.

    Estimates are made from short contexts to long ones; each join meets a gram at most as
    often as there are different characters."""
    context = F.expr("substring(gram, 1, length(gram) - 1)")
    of = counts.groupBy(context.alias("context")).agg(*[x for c in "ab" for x in (F.sum(c).alias(f"n{c}"), F.count(F.when(F.col(c) > 0, 1)).alias(f"t{c}"))])
    wanted = grams.select(_endings().alias("gram")).distinct().withColumn("context", context)
    known = wanted.join(counts, "gram", "left").join(of, "context", "left").drop("context").na.fill(0)
    known = common.written(known.withColumn("length", F.length("gram")), "url-grams")
    symbols = counts.where(F.length("gram") == 1).count() + 1
    below = None
    for length in range(1, ORDER + 2):
        own = known.where(F.col("length") == length)
        if below is None:
            own = own.withColumns({f"p{c}": F.lit(1.0) / symbols for c in "ab"})
        else:
            own = own.withColumn("rest", F.expr("substring(gram, 2)")).join(below, "rest")
        mixed = {c: (F.col(c) + F.col(f"t{c}") * F.col(f"p{c}")) / (F.col(f"n{c}") + F.col(f"t{c}")) for c in "ab"}
        own = own.select("gram", *[F.when(F.col(f"n{c}") >= LEAST_SEEN, mixed[c]).otherwise(F.col(f"p{c}")).alias(f"p{c}") for c in "ab"])
        below = own.withColumnRenamed("gram", "rest")
    return own.select("gram", F.floor((F.ln("pa") - F.ln("pb")) * UNIT + 0.5).cast("long").alias("ratio"))


def scored(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(uid, score) of each row of urls (uid, url): thousandths of a log ratio by symbol."""
    symbols = urls.select("uid", F.explode(_grams(F.col("url"))).alias("gram"))
    seen = common.written(symbols.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "url-seen")
    ratios = common.written(log_ratios(seen.select("gram"), counts).join(seen, "gram"), "url-ratios")
    sums = heavy.joined(symbols, ratios, "gram", "n").groupBy("uid").agg(F.sum("ratio").alias("s"), F.count(F.lit(1)).alias("n"))
    score = F.floor(F.col("s") / (F.col("n") * (UNIT / 1000))).cast("long")
    return sums.select("uid", F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), score)).alias("score"))


def threshold(histogram: list[tuple[int, int, int]]) -> int:
    """The score from which urls are allowed: of 0 and the scores in histogram (score,
    allowed, blocked) the one with the greatest sum of both classes' shares that are judged
    right, nearest to 0 and then least. 0 if a class is missing: no evidence, no ratio."""
    a, b = sum(x[1] for x in histogram), sum(x[2] for x in histogram)
    if not a or not b:
        return 0
    ordered = sorted({0: (0, 0, 0)} | {x[0]: x for x in histogram}, key=int)
    own = {x[0]: x for x in histogram}
    best, left_a, right_b = [], a, 0
    for s in ordered:
        best.append((-(left_a * b + right_b * a), abs(s), s))
        _, x, y = own.get(s, (s, 0, 0))
        left_a, right_b = left_a - x, right_b + y
    return min(best)[2]


def judge(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """(row, host, path, rule, score, verdict) of each row of pages; row is a struct of the
    columns keep (all of them by default), so their names can't clash with the others.

    rule is null and score, in thousandths, isn't where no rule fits; a url is allowed from the
    calibrated threshold on. A null url is judged as an empty one. Without examples, or with
    those of one class only, every score is compared with 0, and without any it is 0: allowed.
    Rows are independent: repeated rows, ids and urls get the same verdict. An empty table
    gives no rows; a url of any length is judged whole."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.struct(*[pages[c] for c in keep or pages.columns]).alias("row"), url.alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict, "uid": F.monotonically_increasing_id()})
    rows = common.written(rows, "url-rows")
    held = kept_from_training(F.col("url"))
    examples = rows.where("rule is not null").select("url", "uid", (F.col("verdict") == "allow").alias("allow"))
    counts = common.written(counted(examples.where(~held)), "url-counts")
    scores = common.written(scored(rows.where(F.col("rule").isNull() | held).select("uid", "url"), counts), "url-scores")
    checked = examples.where(held).select("uid", F.col("allow").cast("long").alias("a")).join(scores, "uid")
    histogram = checked.groupBy("score").agg(F.sum("a").alias("a"), F.sum(1 - F.col("a")).alias("b"))  # 2 * FARTHEST + 1 rows at most
    least = threshold([tuple(r) for r in histogram.collect()])
    free = rows.where("rule is null").join(scores, "uid").withColumn("verdict", F.when(F.col("score") >= least, "allow").otherwise("block"))
    ruled = rows.where("rule is not null").withColumn("score", F.lit(None).cast("long"))
    return free.unionByName(ruled).select("row", "host", "path", "rule", "score", "verdict")


def keep_allowed(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """The rows of pages whose url is allowed, with all their columns."""
    return judge(pages, rules, url_col).where("verdict = 'allow'").select("row.*")
