"""The extendible-hash index: doublings, pages, collisions and clashing names."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from chronotext.llm import exact_dedup

NAMES = ["id", "hash", "norm", "bucket", "cell", "depth", "page", "points"]
dice = random.Random(4)
ROWS = [(i, dice.choice([f"text {i % 150}", f" te xt{i % 150}\n", "hot  text", None, ""])) for i in range(600)] + [(7, "hot text"), (7, "hot text"), (None, "hot text  "), (None, "alone")]


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    return sorted((repr((i, None if (b := min(g := groups[k := re.sub(r"[\x20\x09-\x0D]", "", t or "")]))[1] else b[2], len(g), (-len(t or ""), i is None, i or 0) == b, hashlib.sha256(k.encode()).hexdigest())) for i, t in rows))


@pytest.fixture(scope="module")
def docs(spark):
    more = [F.lit(None if k % 2 else "x").cast("string").alias(c) for k, c in enumerate(NAMES)]
    return spark.createDataFrame(ROWS, "doc_id long, text string").select("*", *more).repartition(3)


@pytest.mark.parametrize(("capacity", "page", "bits"), [(4096, 8192, 16), (1, 10, 2)])
def test_by_definition(docs, capacity, page, bits):
    got = [repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in exact_dedup.find_copies(docs, capacity=capacity, page=page, bits=bits).collect()]
    assert sorted(got) == plain(ROWS)
    kept = exact_dedup.drop_copies(docs, capacity=capacity, page=page, bits=bits)
    assert kept.columns == docs.columns
    assert kept.count() == len({r.split("'")[1] for r in got})


def test_doubling_and_pages(docs):
    rounds = []
    index, entries = exact_dedup.build_index(docs, capacity=1, page=10, bits=2, rounds=rounds)
    assert len(rounds) > 3 and rounds == list(range(2, 2 + len(rounds)))
    sizes = [r.n for r in index.groupBy("bucket").agg(F.countDistinct("hash").alias("n")).collect()]
    assert max(sizes) == 1 and entries.count() <= 4


def test_texts_of_one_hash_stay_apart(docs, monkeypatch):
    plain_rows = exact_dedup._rows
    monkeypatch.setattr(exact_dedup, "_rows", lambda *a: plain_rows(*a).withColumn("hash", F.lit(5).cast("long")))
    got = [repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in exact_dedup.find_copies(docs, capacity=1, page=50, bits=2).collect()]
    assert sorted(got) == plain(ROWS)


def test_string_ids_and_none(spark, docs):
    named = docs.select(F.concat(F.lit("k"), F.lpad(F.col("doc_id").cast("string"), 4, "0")).alias("doc_id"), "text")
    (r,) = exact_dedup.find_copies(named).where("doc_id = 'k0007'").limit(1).collect()
    assert r.text_sha256 in {hashlib.sha256(x).hexdigest() for x in (b"", b"hottext", *(f"text{k}".encode() for k in range(150)))}
    assert exact_dedup.find_copies(named.where("false")).count() == 0
