"""URL rules, the language-model ratio against a plain version, and odd tables."""

import hashlib
import math
from collections import Counter, defaultdict

from chronotext.llm import common, url_filter
from chronotext.llm.queries import URL_RULES

DDL = "page_id long, url string"


def parts(url):
    """(host, path) by plain splits."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), tail[:stop]


def rule(url):
    host, path = parts(url)
    fit = [(len(r), v, r) for v, r in URL_RULES if ("." + host).endswith("." + r.split("/")[0]) and path.startswith(r[r.index("/") :])]
    return max(fit)[1:] if fit else (None, None)


def plain(urls):
    """(verdict, score) of each url, by dictionaries."""
    k = url_filter.ORDER
    padded = lambda u: "\x02" * k + u + "\x03"
    held = lambda u: hashlib.md5(u.encode()).hexdigest()[0] in "01"
    counts = {v: defaultdict(Counter) for v in ("allow", "block")}
    seen = set()
    for u in urls:
        v = rule(u)[0]
        if v and not held(u or ""):
            s = padded(u or "")
            for i in range(k, len(s)):
                seen.add(s[i])
                for n in range(k + 1):
                    counts[v][s[i - n : i]][s[i]] += 1

    def chance(v, context, c):
        p = 1 / (len(seen) + 1)
        for n in range(k + 1):
            own = counts[v][context[k - n :]]
            total = sum(own.values())
            if total >= url_filter.LEAST_SEEN:
                p = (own[c] + len(own) * p) / (total + len(own))
        return p

    def score(u):
        s = padded(u)
        ratios = [math.floor((math.log(chance("allow", s[i - k : i], s[i])) - math.log(chance("block", s[i - k : i], s[i]))) * 1e6 + 0.5) for i in range(k, len(s))]
        return math.floor(sum(ratios) / (len(ratios) * 1000))

    scores = {u: score(u or "") for u in set(urls)}
    checked = [(scores[u], rule(u)[0] == "allow") for u in urls if rule(u)[0] and held(u or "")]
    a, b = sum(x for _, x in checked), sum(not x for _, x in checked)
    least = 0
    if a and b:
        worth = lambda t: sum(s >= t for s, x in checked if x) / a + sum(s < t for s, x in checked if not x) / b
        least = min({s for s, _ in checked} | {0}, key=lambda t: (-round(worth(t), 12), abs(t), t))
    return {u: (rule(u)[0], None) if rule(u)[0] else ("allow" if scores[u] >= least else "block", scores[u]) for u in urls}


def judged(df):
    return {(r.row.page_id, r.host, r.path, r.rule, r.verdict, r.score) for r in url_filter.judge(df, URL_RULES, keep=["page_id"]).collect()}


def held_to_plain(df):
    rows = [tuple(r) for r in df.select("page_id", "url").collect()]
    said = plain([u for _, u in rows])
    assert judged(df) == {(i, *parts(u), rule(u)[1], *said[u]) for i, u in rows}


ODD = [None, "", "no scheme/path", "http://", "HTTP://WWW.Example.NET/en/1?q=/de/#x", "x://net", "x://net/", "x://a.net?/en/", "http://org/fr/", "http://xorg/fr/", "http://a.org/fr", "http://example.com/de/\U0001f600é", "a://b://c.net/z", "http://e\nx.net/\n?", "http://É.NET/"]


def test_rules_and_odd_urls(spark):
    held_to_plain(spark.createDataFrame(list(enumerate(ODD)) + [(3, ODD[5]), (None, ODD[4]), (None, ODD[4])], DDL))


def test_ratio_by_dictionaries(spark):
    held_to_plain(common.table(spark, "/root/testdata/sf0.001", "pages").limit(40))


def test_ratio_learns(spark):
    good = [f"http://a{i}.org/fr/garden-{i % 13}" for i in range(60)]
    bad = [f"http://b{i}.net/pills-{i % 7}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(good + bad + ["http://c.com/garden-4", "http://c.com/pills-4"])), DDL)
    said = {r.row.url: r.verdict for r in url_filter.judge(df, URL_RULES).collect()}
    assert said["http://c.com/garden-4"] == "allow" and said["http://c.com/pills-4"] == "block"
    assert url_filter.keep_allowed(df, URL_RULES).columns == ["page_id", "url"]
    assert "http://c.com/pills-4" not in {r.url for r in url_filter.keep_allowed(df, URL_RULES).collect()}


def test_without_rules_examples_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a/b"), (2, None)], DDL)
    assert {(r.verdict, r.score) for r in url_filter.judge(df, []).collect()} == {("allow", 0)}
    assert url_filter.judge(df.where("false"), URL_RULES).count() == 0


def test_long_url_and_clashing_names(spark):
    long = "http://example.com/" + "ab/" * 100_000
    df = spark.createDataFrame([("x", "y", "z", "r", "s", "v", long), ("x", "y", "z", "r", "s", "v", "http://a.net/")], "uid string, host string, path string, rule string, score string, verdict string, url string")
    got = url_filter.judge(df, URL_RULES).collect()
    assert {(len(r.path), r.row.uid, r.row.rule) for r in got} == {(300_001, "x", "r"), (1, "x", "r")}
    assert url_filter.keep_allowed(df, URL_RULES).columns == df.columns


def test_threshold():
    assert url_filter.threshold([]) == url_filter.threshold([(5, 3, 0)]) == 0
    assert url_filter.threshold([(-4, 0, 5), (-2, 3, 1), (7, 4, 0)]) == -2
    assert url_filter.threshold([(3, 0, 2), (9, 2, 0)]) == 9
    assert url_filter.threshold([(-9, 0, 2), (9, 2, 0)]) == 0
