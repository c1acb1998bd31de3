"""Importance resampling against plain counts, for one word and for longer n-grams."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from chronotext.llm import common, resampling

DDL = "doc_id long, text string"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def buckets_of(text, longest, buckets):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    own = [buckets_of(t, longest, buckets) for _, t in docs]
    s, t = Counter(b for x in own for b in x), Counter(b for x in target for b in buckets_of(x, longest, buckets))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    rows = []
    for (i, text), x in zip(docs, own):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, x))
        rows.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got(spark, docs, target, **more):
    df, aim = spark.createDataFrame(docs, DDL), spark.createDataFrame([(t,) for t in target], "text string")
    return sorted((tuple(r) for r in resampling.resample(df, aim, **more).collect()), key=repr)


def tables(spark):
    sf = "/root/testdata/sf0.001"
    return [tuple(r) for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()], [r.text for r in common.table(spark, sf, "benchmark").collect()]


@pytest.mark.parametrize(("longest", "size"), [(1, 1 << 21), (3, 5000)])
def test_by_counts(spark, monkeypatch, longest, size):
    monkeypatch.setattr(resampling, "SLICE", size)
    docs, target = tables(spark)
    assert got(spark, docs, target, longest=longest, buckets=997) == plain(docs, target, longest, 997)


def test_odd_rows(spark):
    long = "One two THREE four 5 " * 40_000
    docs = [(1, None), (2, ""), (None, "a b c " * 9), (None, "a b c " * 9), (3, "É\x7fé日本 x_y\x00z " * 8), (3, "É\x7fé日本 x_y\x00z " * 8), (4, long), *[(10 + i, f"w{i % 3} " * 25) for i in range(40)]]
    for target in (["one two", None], []):
        for percent in (10, 100):
            assert got(spark, docs, target, percent=percent) == plain(docs, target, percent=percent)
    assert got(spark, [], ["a"]) == []


def test_ties_go_to_the_smaller_id(spark):
    from pyspark.sql import functions as F

    rows = common.written(spark.createDataFrame([(i, i % 2) for i in range(50)] + [(7, 1)] * 3, "id long, score long").repartition(5), "t")
    ranks = resampling.ranked(rows, 50, [F.col("score").desc(), F.col("id")]).where("rank is not null").orderBy("rank").collect()
    assert [(r.rank, r.score, r.id) for r in ranks] == [(k + 1, s, i) for k, (s, i) in enumerate(sorted([(i % 2, i) for i in range(50)] + [(1, 7)] * 3, key=lambda x: (-x[0], x[1]))[:26])]


def test_suffix_array_shares_words():
    ids, texts = np.array([1, 2, 1, 2, 3, 1, 2, 1]), np.array([0, 0, 0, 0, 0, 1, 1, 1])
    left = np.searchsorted(texts, texts, "right") - np.arange(8)
    order, shared = resampling.suffix_array(ids, left, 3)
    own = [tuple(ids[i : i + min(3, left[i])].tolist()) for i in order]
    assert own == sorted(own)
    assert shared.tolist() == [0, *[next((k for k in range(3) if k >= min(len(a), len(b)) or a[k] != b[k]), 3) for a, b in zip(own, own[1:])]]


def test_draw_and_clashing_names(spark):
    df = spark.createDataFrame([(i, f"w{i} " * 30, "a", 1, 2, 3) for i in range(30)], "doc_id long, text string, id string, rank int, weight int, part int")
    drawn = resampling.draw(df, df.select("text"))
    assert drawn.columns == df.columns and drawn.count() == 3
