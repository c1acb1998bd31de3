"""Locating, readings, trees and slots against plain versions of their rules."""

import random
import re

import pandas as pd
import pytest
from compare import difference
from pyspark.sql import functions as F

from chronotext.functions import trees
from chronotext.operators import locating, readings
from chronotext.plans import auditing
from chronotext.streaming import slots

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(auditing.SQL))
def test_sql(spark, name):
    assert difference(spark, auditing.QUERIES[name], auditing.SQL[name], SF) == ""


def located_by_walking(pieces, lines):
    """place -> (at, reading), by walks through the whole text."""
    text, owner = "".join(b for b, _ in pieces), [i for i, (b, _) in enumerate(pieces) for _ in b]
    cursor, out = 0, {}
    for place, line in lines:
        if line is None or len(line) < 2:
            continue
        at = text.find(line, cursor)
        at = text.find(line) if at < 0 else at
        if at < 0:
            continue
        cursor = at + len(line)
        cut = at > 0 and owner[at - 1] == owner[at] or cursor < len(text) and owner[cursor - 1] == owner[cursor]
        out[place] = (at, None if cut else "".join(pieces[i][1] for i in sorted(set(owner[at:cursor]))))
    return out


def test_located(spark):
    dice = random.Random(21)
    pages, lines, want = [], [], {}
    for key in range(60):
        pieces = [("".join(dice.choice("ab") for _ in range(dice.choice([0, 1, 1, 2, 3]))), dice.choice(["x", "yz"])) for _ in range(dice.randrange(120))]
        text = "".join(b for b, _ in pieces)
        own = []
        for place in range(dice.randrange(12)):
            at = dice.randrange(len(text) + 1)
            own.append((place, dice.choice([None, "a", text[at : at + dice.randrange(30)], text[at : at + dice.randrange(30)], "abbaabbba"])))
        pages.append((key, pieces))
        lines += [(key, *x) for x in own]
        want |= {(key, p): v for p, v in located_by_walking(pieces, own).items()}
    kind = "key int, pieces array<struct<base string, reading string>>"
    asked = spark.createDataFrame(lines + [(999, 0, "ab")], "key int, place long, text string")
    got = locating.located(spark.createDataFrame([*pages, (1000, None)], kind), asked, ["key"]).collect()
    assert {(r.key, r.place): (r.at, r.reading) for r in got} == want and len(want) > 100


def test_lines_find_their_own_occurrence(spark):
    """Every line of a document that isn't rotated is found at its own place."""
    rows = auditing.located_lines(spark, SF).where("doc_id % 2 = 0").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "at"))).alias("x")).collect()
    for r in rows:
        assert [x.at for x in r.x] == sorted(x.at for x in r.x)
    repeated = locating.Occurrences("ab" * 50_000)
    assert repeated.find("ab" * 20, 31) == 32 and repeated.find("abc") == -1 and locating.Occurrences("").find("ab") == -1


def test_matched_forward_by_walking(spark):
    dice = random.Random(22)
    rows = {k: [(i, dice.randrange(9) * 1.0, dice.choice("abc")) for i in range(dice.randrange(1, 9))] for k in range(80)}
    lines = {k: [(i, i * 1.5, dice.choice("abcd")) for i in range(dice.randrange(1, 7))] for k in range(80)}
    want, by_place = set(), 0
    for k in rows:
        starts = list(dict.fromkeys(s for _, s, _ in rows[k]))
        cursor = 0
        by_place += len(starts) == len(lines[k])
        for i, (place, start, text) in enumerate(lines[k]):
            if len(starts) == len(lines[k]):
                want.add((k, place, start, starts[i]))
                continue
            j = next((j for j in range(cursor, len(rows[k])) if rows[k][j][2] == text), None)
            if j is not None:
                want.add((k, place, start, rows[k][j][1]))
                cursor = j + 1
    df = [spark.createDataFrame([(k, *r) for k, x in side.items() for r in x], "k int, place long, start double, text string") for side in (lines, rows)]
    got = locating.matched_forward(*df, ["k"]).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and 5 < by_place < 75


def by_pattern(annotated, theirs):
    """Differences by one pattern of the whole line, which tries our reading of a run first."""
    line = readings.tokens(annotated)
    pattern = "".join(re.escape(x) if isinstance(x, str) else f"({re.escape(x['ours'])}|.+?)" for x in line)
    runs = [x for x in line if not isinstance(x, str)]
    if not runs:
        return []
    m = re.fullmatch(pattern, theirs)
    if not m:
        return None
    return [x | {"theirs": t} for x, t in zip(runs, m.groups()) if t != x["ours"] and re.fullmatch("[ぁ-ゖー]+", t)]


def test_differences_by_pattern():
    dice = random.Random(23)
    none = changed = 0
    for _ in range(3000):
        parts = [dice.choice(["が", "か", "{山|か}", "{川|がか}", "{木|き}", " ", "a"]) for _ in range(dice.randrange(1, 8))]
        annotated = "".join(parts)
        read = [re.sub(r"\{.\|(.*)\}", lambda m: dice.choice([m[1], m[1], "きが", "が", "山"]), p).strip() for p in parts]
        theirs = "".join(read) + dice.choice(["", "", "か"])
        got = readings.differences(annotated, theirs)
        assert got == by_pattern(annotated, theirs), (annotated, theirs)
        none += got is None
        changed += bool(got)
    assert none > 50 and changed > 300


def test_own_reading_first_and_other_words():
    """A shortest match alone would cut the line at the wrong sound."""
    assert readings.differences("{笑顔|えがお}が{並|なら}び", "えがおがならび") == []
    assert readings.differences("{笑顔|えがお}が{並|なら}び", "えみがなみび") == [{"base": "笑顔", "ours": "えがお", "parts": [{"base": "笑顔", "ours": "えがお"}], "theirs": "えみ"}, {"base": "並", "ours": "なら", "parts": [{"base": "並", "ours": "なら"}], "theirs": "なみ"}]
    assert readings.differences("{山|やま}と", "うみに") is None
    (both,) = readings.differences("{山|やま}・{川|カワ}", "さんせん")
    assert (both["base"], both["ours"], both["theirs"]) == ("山川", "やまかわ", "さんせん")


def test_written():
    part = lambda base, ours: {"base": base, "ours": ours}
    diff = lambda base, ours, theirs, *parts: {"base": base, "ours": ours, "theirs": theirs, "parts": list(parts) or [part(base, ours)]}
    assert readings.written("山と川", [diff("山", "やま", "さん")]) == ("山(さん)と川", 1, 0)
    assert readings.written("山(ヤマ)と", [diff("山", "やま", "さん")]) == ("山(さん)と", 1, 0)
    assert readings.written("山(さん)と", [diff("山", "やま", "さん")]) == ("山(さん)と", 0, 1)
    assert readings.written("火山と", [diff("山", "やま", "さん")]) == ("火山と", 0, 1)
    assert readings.written("山と", [diff("山", "やま", "さんさんさん")]) == ("山と", 0, 1)
    # one run in the line, cut in two by a tokenizer, is one again
    assert readings.written("輪切り", [diff("輪切", "わきり", "りんせつ", part("輪", "わ"), part("切", "きり"))]) == ("輪切(りんせつ)り", 1, 0)
    # parts at the ends keep what fits; the rest is divided by signs
    assert readings.written("山・川", [diff("山川", "やまかわ", "さんかわ", part("山", "やま"), part("川", "かわ"))]) == ("山(さん)・川", 1, 0)
    assert readings.written("山・川木", [diff("山川木", "やまかわき", "あいうえおか", part("山", "やま"), part("川木", "かわき"))]) == ("山(あい)・川木(うえおか)", 2, 0)


def test_reading_columns(spark):
    own = readings.columns()
    df = spark.createDataFrame([("{山|やま}と", "さんと", "山と"), (None, "x", "y"), ("{山|やま}", "x y", "山"), ("と", "と", None)], "a string, t string, l string")
    got = df.select(own["differences"]("a", "t").alias("d"), "l").select("d", own["written"]("l", "d").alias("w")).collect()
    assert [(r.d and [x.theirs for x in r.d], r.w.line) for r in got] == [(["さん"], "山(さん)と"), (None, None), ([], "山"), ([], None)]
    rows = {(r.conv_id, r.turn): r for r in auditing.reading_differences(spark, SF).collect()}
    some = 0
    for r in auditing._annotated(spark, SF).collect():
        want = by_pattern(r.annotated, r.theirs)
        some += bool(want)
        assert rows[r.conv_id, r.turn].diffs == (None if want is None else ",".join(f"{x['base']}:{x['ours']}:{x['theirs']}" for x in want))
    assert some


LEAF = lambda text, a, b, ruby=None: {"text": text, "startTime": a, "endTime": b, "ruby": ruby}


def tree(spark, line):
    return spark.createDataFrame([(1, 0, line)], f"k int, place int, line {trees.LINE.replace(': ', ':')}")


WORD = {"text": "ab", "startTime": 1.0, "endTime": 2.0, "syllables": [LEAF("a", 1.0, 1.5, [{"text": "x", "startTime": 1.0, "endTime": 1.25}, {"text": "y", "startTime": 1.25, "endTime": 1.5}]), LEAF("b", 1.5, 2.0)]}
DOC = {"fullText": "ab c", "translation": None, "startTime": 1.0, "endTime": None, "words": [WORD, {"text": "c", "startTime": 2.0, "endTime": 3.0, "syllables": None}]}


def times(line):
    """All times of a tree, depth first."""
    out = [line["startTime"], line["endTime"]]
    for key in ("words", "syllables", "ruby"):
        for child in line.asDict().get(key) or []:
            out += times(child)
    return out


def test_every_time_of_a_tree(spark):
    df = tree(spark, DOC)
    was = times(df.head().line)
    one = lambda how: times(df.select(how(F.col("line")).alias("line")).head().line)
    assert len(was) == 14 and was[1] is None
    assert one(lambda x: trees.shifted(x, F.lit(0.257))) == [t and round(t + 0.26, 2) for t in was]
    assert one(lambda x: trees.shifted(x, F.lit(-1.5))) == [t and max(0.0, t - 1.5) for t in was]
    assert one(lambda x: trees.clamped(x, F.lit(1.2), F.lit(1.9))) == [t and min(max(t, 1.2), 1.9) for t in was]
    whole = tree(spark, DOC | {"endTime": 3.0}).select(trees.squeezed(F.col("line"), F.lit(10.0), F.lit(11.0)).alias("line")).head().line
    assert times(whole) == [round(10 + (t - 1) / 2 + 1e-9, 2) for t in [1.0, 3.0, *was[2:]]]
    kept = tree(spark, DOC | {"endTime": 3.0}).select(trees.squeezed(F.col("line"), F.lit(10.0), F.lit(20.0)).alias("line")).head().line
    assert times(kept) == [t + 9 for t in [1.0, 3.0, *was[2:]]]


def test_parents_from_children_and_leaves(spark):
    moved = {**DOC, "startTime": 9.0, "words": [{**WORD, "startTime": 7.0, "endTime": 7.0, "syllables": [{**WORD["syllables"][0], "startTime": 5.0}, WORD["syllables"][1]]}, DOC["words"][1]]}
    got = tree(spark, moved).select(trees.spanned(F.col("line")).alias("line"), trees.leaves(F.col("line")).alias("own")).head()
    assert times(got.line) == [1.0, 3.0, *times(tree(spark, DOC).head().line)[2:]]
    assert [(x.text, x.startTime, x.endTime) for x in got.own] == [("x", 1.0, 1.25), ("y", 1.25, 1.5), ("b", 1.5, 2.0), ("c", 2.0, 3.0)]
    none = tree(spark, {**DOC, "words": None}).select(trees.spanned(F.col("line")).alias("line"), trees.leaves(F.col("line")).alias("own")).head()
    assert none.own == [] and times(none.line) == [1.0, None]


def test_edits_move_a_line_and_refuse_another_text(spark):
    line = {"fullText": "a", "translation": None, "startTime": 1.0, "endTime": 2.0, "words": [{"text": "a", "startTime": 1.0, "endTime": 2.0, "syllables": None}]}
    lines = tree(spark, line)
    edit = lambda text: spark.createDataFrame([(1, 0, 0.5, text)], "k int, place int, d double, t string")
    got = trees.edited(lines, edit("a"), ["k"], F.lit(0.0)).head()
    assert got.moved and got.line.words[0].startTime == 1.5
    with pytest.raises(Exception, match="text has changed"):
        trees.edited(lines, edit("b"), ["k"], F.lit(0.0)).select("line").collect()
    kept = trees.edited(lines, edit("b"), ["k"], F.lit(0.0), strict=False).head()
    assert kept.moved is None and times(kept.line) == times(lines.head().line)
    assert not trees.edited(lines, edit("a").where("false"), ["k"], F.lit(0.0)).head().moved


def wipes_by_loop(frames, rule):
    """The rules over a slot's frames (index, text, bright), in sets."""
    recent, line, size, begun, out = [], None, 0, False, []
    for index, text, bright in frames:
        recent = [*recent, set(text or [])][-3:]
        shown = set(bright or [])
        if line is not None:
            still = len(line & shown) / len(line)
            columns = {c % rule.width for c in line}
            left = {c for c in line if c % rule.width < min(columns) + max(rule.left, (max(columns) - min(columns)) // 5)}
            if not begun and still < 0.95 and len(left & shown) / len(left) < 0.8:
                out.append((index, size))
                begun = True
            if still < 0.15:
                line = None
        stable = recent[0] & recent[1] & recent[2] if len(recent) == 3 else set()
        if len(stable) > rule.least and (line is None or len(stable - line) > max(rule.other, size * 0.4)):
            line, size, begun = stable, len(stable), False
    return out


def test_slots_by_loop(spark):
    got = {}
    for r in auditing.slot_wipes(spark, SF).collect():
        got.setdefault(r.slot, []).append((r["index"], r.size))
    frames = {}
    for r in auditing._frames(spark, SF).orderBy("slot", "index").collect():
        frames.setdefault(r.slot, []).append((r["index"], r.text, r.bright))
    for slot, own in frames.items():
        assert sorted(got.get(slot, [])) == wipes_by_loop(own, auditing.SLOT_RULE)
    assert got


def test_slots_on_a_stream_with_a_restart(spark, tmp_path):
    frames = auditing._frames(spark, SF).where("slot < 12")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cuts, last = [0, 5, 23, 40, 10_000], None
    try:
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            frames.where((F.col("index") >= a) & (F.col("index") < b)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
            stream = spark.readStream.schema(frames.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
            # each start reads what is new and goes on from the state of the one before
            last = slots.wipes(stream, auditing.SLOT_RULE).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
            last.awaitTermination(180)
            assert last.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, slots.wipes(frames, auditing.SLOT_RULE).collect())) and got


def test_slots_of_nothing(spark):
    df = spark.createDataFrame([("a", 1, None, None), ("a", 2, [], [1])], "slot string, index long, text array<int>, bright array<int>")
    assert slots.wipes(df).count() == 0 and slots.wipes(df.where("false")).count() == 0
    assert pd.DataFrame(slots.wipes(df).collect()).empty
