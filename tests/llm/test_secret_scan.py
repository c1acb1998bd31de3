"""Secret scans against a plain version with windows counted anew, and many candidates."""

import math
import random
import re
import time

from chronotext.llm import secret_scan as scan

dice = random.Random(9)
B64 = scan.CLASSES["entropy_base64"][0]
KEY = "".join(dice.choices(B64[:62], k=40))
TEXTS = [None, "", f"example_key={KEY}", f"path/example/{KEY}/x", f"{KEY[:30]}0123456789{KEY[:30]}", "placeholder" * 6, "a" * 50, "PASSWORD = 'hunter22x'", "token: short", "AKIA" + "Q2W3" * 5, "deadbeef0123" * 4,
         "123e4567-e89b-12d3-a456-426614174000", f"é {KEY[:19]} \U0001f600 {KEY}", "secret=" + "x" * 5, "x " * 300 + f"api_key:{KEY}", " ".join("".join(dice.choices(B64, k=24)) for _ in range(300))]


def entropy(s):
    return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))


def plain(text):
    text = text or ""
    base = [(m.start(), 0, m.end(), "assign") for m in re.finditer(scan.ASSIGN, text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    bare, more = text, []
    for part in scan.BLANKED:
        bare = re.sub(f"(?i){part}", " " * len(part), bare)
    for k, (kind, (characters, least)) in enumerate(scan.CLASSES.items()):
        for m in re.finditer("[" + re.escape(characters) + "]{20,}", bare):
            if any(re.search(a, m[0]) for a in scan.ALLOWED):
                continue
            spans = []
            for i in range(len(m[0]) - 19):
                if entropy(m[0][i : i + 20]) >= least - 1e-9:
                    if spans and spans[-1][1] >= i:
                        spans[-1][1] = i + 20
                    else:
                        spans.append([i, i + 20])
            more += [(m.start() + a, 3 + k, m.start() + b, kind) for a, b in spans]
    return sorted(base), sorted(more)


def test_by_definition(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, bare string")
    got = {r.doc_id: tuple([(s.start, s.place, s.stop, s.kind) for s in spans] for spans in (r.base, r.added)) for r in scan.find_secrets(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}
    assert got[2][1] and got[3][1] and len(got[4][1]) == 2 and not got[5][1]


def test_many_candidates_in_one_text(spark):
    seconds = []
    for n in (4000, 16000):
        text = " ".join("".join(dice.choices("ghijklmn", k=22)) for _ in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        t = time.time()
        assert scan.find_secrets(df).count() == 1 and len(scan.find_secrets(df).head().base) == 0
        seconds.append(time.time() - t)
    assert seconds[1] < 10 * seconds[0] + 5


def test_none(spark):
    assert scan.find_secrets(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def test_long_candidates_take_time_by_length(spark):
    """A run of a megabyte without a blank; times grow with length, and spans are those of
    windows counted anew."""
    dice = random.Random(31)
    run = "".join(dice.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1 << 20))
    took, w = {}, scan.WINDOW
    for n in (1 << 15, 1 << 18, 1 << 20):
        df = spark.createDataFrame([(1, "x " + run[:n] + " y")], "doc_id long, text string")
        began = time.time()
        (row,) = scan.find_secrets(df).collect()
        took[n] = time.time() - began
        if n == 1 << 15:
            want = []
            for i in range(n - w + 1):
                if entropy(run[i : i + w]) >= scan.CLASSES["entropy_base64"][1] - 1e-9:
                    if want and want[-1][1] >= i:
                        want[-1][1] = i + w
                    else:
                        want.append([i, i + w])
            assert [[s.start - 2, s.stop - 2] for s in row.added if s.kind == "entropy_base64"] == want
    assert took[1 << 20] < 8 * took[1 << 18] and took[1 << 20] < 60, took
