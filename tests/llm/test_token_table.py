"""Token tables against an untouched tokenizer, and lookups against the full read."""

import random
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronotext.llm import byte_bpe, token_table

PATH = token_table.tokenizer_path()
TOKENIZER = Tokenizer.from_file(PATH)
ROWS = [(i, f"text {i} of many words, don't stop <|endoftext|> here" if i % 7 else None) for i in range(-30, 300)] + [(5, "again"), (5, "again"), (None, "no id"), (None, ""), (-(2**63), "least"), (2**63 - 1, "a <|endoftext|> b")]


def plain(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in ROWS], "doc_id long, text string, path string, start string").repartition(3)


def test_encoder_on_odd_texts():
    tok, dice = TOKENIZER, random.Random(3)
    marks = ["a", "b ", " ", "  ", "\n", "\t", "é", "'s", "1", "<|endoftext|>", "漢", " ", "　", ".", "don't", "\x0b", "\U0001f600", " x", "\r\n"]
    texts = ["", "<|endoftext|>"] + ["".join(dice.choices(marks, k=dice.randrange(12))) for _ in range(2000)]
    got = byte_bpe.Encoder(PATH).encode(texts)
    assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_rows_and_lookups(spark, docs):
    manifest = token_table.write_tokens(docs, PATH, end_id=2, block=200)  # many blocks, so that lookups search
    every = token_table.read_tokens(manifest).collect()
    own = lambda r: (r.doc_id, r.start, r.n_tokens, bytes(r.ids))
    assert sorted((r.doc_id is None, r.doc_id or 0, zlib.crc32(bytes(r.ids))) for r in every) == sorted((i is None, i or 0, zlib.crc32(b"".join(k.to_bytes(4, "little") for k in plain(t)))) for i, t in ROWS)
    at = 0
    for r in sorted(every, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.start)):
        assert (r.start, r.n_tokens * 4) == (at, len(r.ids))
        at += r.n_tokens
    wanted = [5, 0, -30, None, 299, 10**6, -(2**63), 2**63 - 1, 5]
    found = token_table.find_tokens(manifest, spark.createDataFrame([(w,) for w in wanted], "doc_id long")).collect()
    assert sorted(map(own, found), key=repr) == sorted((own(r) for r in every if r.doc_id in wanted), key=repr)
    shards = [token_table.Reader(p) for (p,) in manifest.select("path").collect()]
    for r in every:
        assert any(s.may_have(token_table.key_of(r.doc_id)) for s in shards)
    absent = [token_table.key_of(k) for k in range(10**6, 10**6 + 2000)]
    assert sum(s.may_have(k) for s in shards for k in absent) < 0.05 * len(absent) * len(shards)
    assert sum(len(s.blocks) for s in shards) > 10


def test_none_and_refused(spark, docs):
    manifest = token_table.write_tokens(docs.where("false"), PATH, end_id=2)
    assert token_table.read_tokens(manifest).count() == 0
    assert token_table.find_tokens(manifest, docs.select("doc_id")).count() == 0
    with pytest.raises(TypeError):
        token_table.write_tokens(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), PATH)
