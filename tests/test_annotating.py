"""Readings on timed lines against a plain version by characters, and the cases that matter."""

import random

from pyspark.sql import functions as F

from chronotext.functions import marks, trees
from chronotext.operators import annotation

LINES = f"song int, place int, line {trees.LINE}"
RULES = "song int, rank int, base string, reading string, begin double, until double"


def line(*words):
    made = [{"text": t, "startTime": float(a), "endTime": float(b), "syllables": None} for t, a, b in words]
    return {"fullText": "".join(w[0] for w in words), "translation": None, "startTime": made[0]["startTime"], "endTime": made[-1]["endTime"], "words": made}


def shape(x):
    """(texts of words, [(text, start, end, reading)] of units)"""
    x = x.asDict(True) if hasattr(x, "asDict") else x
    units = [u for w in x["words"] for u in (w["syllables"] or [{**w, "ruby": None}])]
    return [w["text"] for w in x["words"]], [(u["text"], round(u["startTime"], 6), round(u["endTime"], 6), "".join(r["text"] for r in u["ruby"] or [])) for u in units]


def by_characters(words, rules):
    text, at = "".join(t for t, *_ in words), [0]
    time = {0: words[0][1]}
    for t, a, b in words:
        n = at[-1]
        time |= {n + i: a + (b - a) * i / len(t) for i in range(len(t) + 1)}
        at.append(n + len(t))
    borders, cuts, over, spent = set(at), set(at), {}, set()
    for a, b in zip(at, at[1:]):
        for rank, base, reading, begin, until in rules:
            if text[a:b] == base and begin - 0.001 <= time[a] <= until + 0.001:
                over.pop((a, b), None)
                if reading:
                    over[a, b] = reading
                    spent |= {rank} if until - begin < 0.001 else set()
    for rank, base, reading, begin, until in sorted(rules, key=lambda r: (-len(r[1]), r[0])):
        a = text.find(base)
        while reading and rank not in spent and a >= 0:
            b = a + len(base)
            first, last = max(x for x in borders if x <= a), min(x for x in borders if x >= b)
            exact = (first, last) == (a, b) and not any(a < x < b for x in borders)
            head, tail = max(x for x in cuts if x <= a), min(x for x in cuts if x > a)
            latest = time[head] if head == a else time[tail]
            if not exact and not any(x < b and y > a for x, y in over) and latest >= begin - 0.001 and time[head] <= until + 0.001:
                borders = {x for x in borders if not first < x < last}
                cuts = {x for x in cuts if not a < x < b} | {a, b}
                over[a, b] = reading
            a = text.find(base, b)
    ordered, words_at = sorted(cuts), sorted(borders)
    return [text[x:y] for x, y in zip(words_at, words_at[1:])], [(text[x:y], round(time[x], 6), round(time[y], 6), over.get((x, y), "")) for x, y in zip(ordered, ordered[1:])]


def test_annotated_by_characters(spark):
    dice, lines, rules, want = random.Random(11), [], [], {}
    for song in range(25):
        own = []
        for rank in range(dice.randrange(9)):
            begin = dice.choice([None, 0.0, dice.randrange(200) / 2])
            until = dice.choice([None, begin, 40.0, 200.0])
            own.append((rank, "".join(dice.choices("abc", k=dice.randrange(1, 4))), dice.choice(["", "x", "yy", "z"]), begin, until))
        rules += [(song, *r) for r in own]
        filled = [(k, b, r, x or 0.0, float("inf") if y is None else y) for k, b, r, x, y in own]
        hit, made = set(), []
        for place in range(8):
            t, words = place * 12.0, []
            for _ in range(dice.randrange(1, 7)):
                d = dice.choice([0.5, 1.0, 2.0])
                words.append(("".join(dice.choices("abc", k=dice.randrange(1, 4))), t, t + d))
                t += d
            made.append(words)
            hit |= {k for k, b, r, x, y in filled for w, s, _ in words if w == b and r and y - x < 0.001 and x - 0.001 <= s <= y + 0.001}
            lines.append((song, place, line(*words)))
        # a rule that is spent on one line is spent for the whole song
        for place, words in enumerate(made):
            want[song, place] = with_spent(words, filled, hit)
    got = annotation.annotated(spark.createDataFrame(lines, LINES), spark.createDataFrame(rules, RULES), ["song"]).collect()
    assert len(got) == len(lines)
    for r in got:
        assert shape(r.line) == want[r.song, r.place], (r.song, r.place)


def with_spent(words, rules, hit):
    """by_characters with rules that were spent elsewhere left for whole words only."""
    none = "\0"  # a base that no text has
    text = "".join(w for w, *_ in words)
    whole = {w for w, *_ in words}
    kept = [r for r in rules if r[0] not in hit or (r[1] in whole and any(w == r[1] and r[3] - 0.001 <= s <= r[4] + 0.001 for w, s, _ in words)) or not text.count(r[1])]
    return by_characters(words, [r if r in kept else (r[0], none, *r[2:]) for r in rules])


def one(spark, words, *rules):
    got = annotation.annotated(spark.createDataFrame([(1, 0, line(*words))], LINES), spark.createDataFrame([(1, i, *r) for i, r in enumerate(rules)], RULES), ["song"])
    return shape(got.first().line)


def test_cases(spark):
    # the longer base first, so a sign isn't read by itself; the rest of a chunk stays beside it
    assert one(spark, [("今日は", 0, 3)], ("日", "ひ", None, None), ("今日", "きょう", None, None)) == (["今日は"], [("今日", 0, 2, "きょう"), ("は", 2, 3, "")])
    # across chunks, with a reading that has stamps
    assert one(spark, [("夜の", 1, 2), ("手を", 2, 3)], ("夜の手", "ナイト[00:01:00]ハンド", 0.0, 9.0)) == (["夜の手を"], [("夜の手", 1, 2.5, "ナイトハンド"), ("を", 2.5, 3, "")])
    # a rule of one moment that found its word does not go on to the translation at that time
    lines = [(1, 0, line(("知", 10, 10.5), ("らない", 10.5, 12))), (1, 1, line(("不知道", 10, 10.1)))]
    got = annotation.annotated(spark.createDataFrame(lines, LINES), spark.createDataFrame([(1, 1, "知", "し", 10.0, 10.0)], RULES), ["song"])
    assert {r.place: shape(r.line)[1][0] for r in got.collect()} == {0: ("知", 10, 10.5, "し"), 1: ("不知道", 10, 10.1, "")}
    # without a reading a word loses its own; nothing to do for nulls and empty tables
    assert one(spark, [("a", 0, 1)], ("a", "x", None, None), ("a", None, None, None), (None, "x", None, None), ("", "x", None, None)) == (["a"], [("a", 0, 1, "")])
    empty = [(1, 0, None), (None, 1, line(("a", 0, 1))), (1, 2, {**line(("a", 0, 1)), "words": None})]
    df = spark.createDataFrame(empty, LINES)
    got = annotation.annotated(df.withColumn("base", F.lit("kept")), spark.createDataFrame([(1, 1, "b", "x", None, None)], RULES), ["song"])
    assert sorted(map(repr, got.drop("base").collect())) == sorted(map(repr, df.collect())) and {r.base for r in got.collect()} == {"kept"}
    assert annotation.annotated(df.where("false"), spark.createDataFrame([], RULES), ["song"]).count() == 0


def test_built(spark):
    rows = [(1, 0, False, "「", None, None), (1, 1, None, "今日", "きょ", None), (1, 2, None, "", "う", None), (1, 3, False, "、", None, None), (1, 4, True, "は", None, None), (2, 0, True, "a", None, None), (2, 1, None, "", "x", None), (3, 0, False, "a", None, None), (4, 0, True, "a", None, "b")]
    units = spark.createDataFrame([(k, n, s, o, r, n * 1.0, n + 0.5, e) for k, n, s, o, r, e in rows], "key int, n int, sung boolean, orig string, reading string, start double, end double, expected string")
    got = {r.key: (r.line, r.problem) for r in annotation.built(units, ["key"]).collect()}
    first = got[1][0]
    assert [(w.text, w.startTime, w.endTime) for w in first.words] == [("「今日、", 1.0, 2.5), ("は", 4.0, 4.5)] and first.fullText == "「今日、は"
    assert [(s.text, [r.text for r in s.ruby]) for s in first.words[0].syllables] == [("今日", ["きょ", "う"])] and first.words[1].syllables is None
    assert [got[k][1] for k in (1, 2, 3, 4)] == [None, "readings go on after none", "nothing is sung", "the text has changed"] and got[2][0] is None


def test_marks(spark):
    df = spark.createDataFrame([("落下傘（パラシュート）と｜夜の手(ナイト)x(y)",), ("{食べる|たべる}{赤い|あか}{いい|いい}",), (None,)], "t string")
    got = [tuple(r) for r in df.select(marks.bracketed(F.col("t")), marks.trimmed(F.col("t")), marks.bare(F.col("t")), marks.read(F.col("t"))).collect()]
    assert got[0][0] == "{落下傘|パラシュート}と{夜の手|ナイト}x(y)"
    assert got[1][1:] == ("{食|た}べる{赤い|あか}{いい|いい}", "食べる赤いいい", "たべるあかいい")
    assert got[2] == (None,) * 4


def test_no_songs_through_the_driver(spark):
    from chronotext.plans import annotating

    plan = annotating.annotated_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def shuffled(spark, df):
    """Rows that the stages of df write for others."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    empty = spark.sparkContext._jvm.java.util.ArrayList()

    def each():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, none, empty)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = each()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for k, n in each().items() if k not in before)


def test_rows_between_stages_are_lines_and_rules(spark):
    words = [("abcdef"[i % 3 :], i / 2, i / 2 + 0.5) for i in range(60)]
    lines = [(song, place, line(*[(t, place * 60 + a, place * 60 + b) for t, a, b in words])) for song in range(5) for place in range(8)]
    rules = [(song, k, "abcdef"[k % 4 : k % 4 + 2 + k % 2], "x", *((None, None) if k % 3 else (k * 1.0, k + 4.0))) for song in range(5) for k in range(40)]
    df = annotation.annotated(spark.createDataFrame(lines, LINES), spark.createDataFrame(rules, RULES), ["song"])
    # by pieces of the lines' texts there were 13515
    assert shuffled(spark, df) <= 4 * (len(lines) + len(rules))


def test_parts_of_a_song(spark, monkeypatch):
    """Lines that reach over borders of parts, and rules that are spent in another part."""
    monkeypatch.setattr(annotation, "PART", 2)
    dice, lines, rules, want = random.Random(12), [], [], {}
    for song in range(12):
        filled = []
        for rank in range(10):
            begin = dice.choice([0.0, dice.randrange(100) / 2])
            until = dice.choice([begin, begin, begin + 3, begin + 500, float("inf")])
            filled.append((rank, "".join(dice.choices("ab", k=dice.randrange(1, 4))), dice.choice(["", "x", "yy"]), begin, until))
        # the same rule twice
        filled.append((10, *filled[0][1:]))
        rules += [(song, *r) for r in filled]
        made, hit = [], set()
        for place in range(9):
            t, words = place * 5.0, []
            for _ in range(dice.randrange(1, 30)):
                words.append(("".join(dice.choices("ab", k=dice.randrange(1, 4))), t, t + 0.5))
                t += 0.5
            made.append(words)
            hit |= {k for k, b, r, x, y in filled for w, s, _ in words if w == b and r and y - x < 0.001 and x - 0.001 <= s <= y + 0.001}
            lines.append((song, place, line(*words)))
        for place, words in enumerate(made):
            want[song, place] = with_spent(words, filled, hit)
    got = annotation.annotated(spark.createDataFrame(lines, LINES), spark.createDataFrame(rules, RULES), ["song"]).collect()
    assert len(got) == len(lines)
    for r in got:
        assert shape(r.line) == want[r.song, r.place], (r.song, r.place)


def test_even_words_as_others():
    """By places in the text the same comes out as by all borders, also where words have readings."""
    dice, read = random.Random(13), 0
    for _ in range(2000):
        words, t = [], 0.0
        for _ in range(dice.randrange(1, 9)):
            text, end = "".join(dice.choices("ab", k=dice.randrange(1, 5))), t + dice.choice([0, 0.37, 40])
            ruby = dice.choice([None, [], [{"text": "q", "startTime": t, "endTime": end}]])
            cut = [x for x in (text[:2], text[2:]) if x]
            words.append({"text": text, "startTime": t, "endTime": end, "syllables": dice.choice([None, None, [{"text": x, "startTime": t, "endTime": end, "ruby": ruby} for x in cut]])})
            t = end
        rules = [("".join(dice.choices("ab", k=k)), dice.choice(["x", "u[00:01:00]v"]), *dice.choice([(0.0, float("inf")), (3.0, 4.0)])) for k in (4, 3, 2, 2, 1)]
        assert annotation._Even.of(words)
        even, want = annotation._Even(words), list(words)
        for r in rules:
            even.put(*r)
            want = annotation._reach_inside(want, *r)
        assert even.done() == want
        read += want != words
    assert read > 1000


def test_rules_of_whole_texts(spark, tmp_path):
    from chronotext.plans import annotating

    text = " ".join(f"{i:03d}wx" for i in range(150))
    spark.createDataFrame([(1, 0, "user", text), (1, 1, "user", "ab"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    own = text.replace(" ", "")
    bases = [own[i : i + 2 + (i + 1) % 3] for i in range(0, len(own) - 6, 7)]
    rules = annotating._sung(spark, str(tmp_path))[1].collect()
    assert [r.base for r in sorted(rules, key=lambda r: r["rank"])] == bases and len(bases) == 107
    # every second rule holds for the first four seconds
    filled = [(n, b, b.upper(), 0.0, 4.0 if n % 2 else float("inf")) for n, b in enumerate(bases)]
    words = [(w, i * 0.37, (i + 1) * 0.37) for i, w in enumerate(text.split())]
    joined, units = by_characters(words, filled)
    got = {(r.conv_id, r.place): (r.n_words, r.n_readings) for r in annotating.annotated_lines(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): (len(joined), sum(r != "" for *_, r in units)), (1, 1): (1, 0), (2, 0): (0, 0)}
