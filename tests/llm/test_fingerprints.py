"""Fingerprints against a plain version: sets of hashed shingles, edits and likeness."""

import hashlib

import pytest

from chronotext.llm import common, fingerprints

SF = "/root/testdata/sf0.001"


def plain(rows):
    """Of each row (id, text) in descending id order: what the query returns, by definition."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    own = {i: fingerprints.sketches([t])[0] for i, t in order}
    out = {}
    for k, (i, t) in enumerate(order):
        after, text = order[(k + 1) % len(order)]
        half = len(t) // 2
        new = t[: len(t) - half] + text[:half]
        sketch = fingerprints.sketches([new])[0]
        near = lambda a, b: fingerprints.likeness(a, b)[0]
        out[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprints.written_as(own[i]), fingerprints.written_as(sketch), near(own[i], sketch), near(own[i], own[after]))
    return out


def compared(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprints.compare_with_next(df).collect()}


def test_by_definition(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)  # many ranges, so rows meet their next across them
    docs = common.table(spark, SF, "documents").select("doc_id", "text")
    assert compared(docs) == plain([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("rows", [[(5, "one two three four five six")], [(1, None), (2, ""), (3, "a b")], [(-4, "x" * 9), (9, "é\U0001f600 b c d e f g")]])
def test_few_rows(spark, rows):
    assert compared(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_none(spark):
    assert fingerprints.compare_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_against_full_sets():
    words = [f"w{i}" for i in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[1000:])
    (x, y), both = fingerprints.sketches([a, b]), 1996 / (2996 + 2996 - 1996)
    near, inside = fingerprints.likeness(x, y)
    assert abs(near - both) < 0.06 and abs(inside - 1996 / 2996) < 0.06
    assert (fingerprints.read_from(fingerprints.written_as(x)) == x).all()
    assert len(fingerprints.merged(x, y)) == len(set(x.tolist()) | set(y.tolist()))


def test_least_id_and_other_ids(spark):
    rows = [(-(2**63), "a b c d e f"), (2**63 - 1, "g h i j k l"), (0, "a b c d e f")]
    assert compared(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)
    with pytest.raises(TypeError):
        fingerprints.compare_with_next(spark.createDataFrame([("x", "y")], "doc_id string, text string"))
