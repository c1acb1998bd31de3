"""The prefix trie against dictionaries of whole prefixes."""

import hashlib
import random
import zlib

import pytest

from chronotext.llm import common, heavy, prefix_trie

DDL = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(conv, []).append((role or "", text or ""))
    rebuilt = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        base = conv - int(f"{'-' if conv < 0 else ''}{abs(conv) % 5}")
        rebuilt[conv] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for conv, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(conv)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in convs if rebuilt[c] == node)))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def held_to_plain(spark, rows, ddl=DDL):
    got = prefix_trie.trie(spark.createDataFrame(rows, ddl)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_by_dictionaries(spark):
    held_to_plain(spark, [tuple(r) for r in common.table(spark, "/root/testdata/sf0.001", "conversations").select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_families(spark, monkeypatch, seed):
    """Few different turns, so prefixes meet within and across families; parts of ends and
    heavy nodes are forced both ways."""
    monkeypatch.setattr(prefix_trie, "ENDS_RANGE", 7)
    monkeypatch.setattr(heavy, "SHARES", (1, 50)[seed - 1])
    dice = random.Random(seed)
    rows = [(c, dice.choice([None, t, 1]), dice.choice(["user", None]), dice.choice(["a", "é", None])) for c in dice.sample(range(-12, 60), 40) for t in range(dice.randint(1, 12))]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(3)]
    held_to_plain(spark, rows)


def test_odd_rows(spark):
    long = "x" * 300_000
    held_to_plain(spark, [(None, 0, "user", "lost"), (-(2**63), 0, None, None), (2**63 - 1, 0, "a", "b"), (7, None, "a", long), (7, 1, "a", long), (8, 0, "u", "1"), (8, 0, "u", "1"), (5, 0, "u1", ""), (6, 0, "u", "1")])
    assert prefix_trie.trie(spark.createDataFrame([], DDL)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], DDL)).count() == 0
    with pytest.raises(TypeError):
        prefix_trie.trie(spark.createDataFrame([("x", 1, "a", "b")], DDL.replace("conv_id long", "conv_id string")))


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 0, "a", "b", 5, "k", 2)], DDL + ", base long, key string, depth long")
    assert {r.depth for r in prefix_trie.trie(df).collect()} <= {0, 1}


def test_one_long_conversation(spark):
    held = prefix_trie.trie(spark.range(20_000).selectExpr("3L as conv_id", "id as turn", "'u' as role", "'t' as text"))
    assert held.agg({"depth": "max"}).first()[0] == 20_000 - prefix_trie.shared_turns(3)
