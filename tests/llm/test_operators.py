"""Small cases of the training-data operators against plain versions of them."""

import bisect
import hashlib
import random
import re

import numpy as np
import pytest
from compare import difference
from pyspark.sql import functions as F

from chronotext.llm import chat_format, common, exact_dedup, mixing, near_dedup, quality, queries, secret_scan, sentence_pieces, substring_dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, row string, id string"
LONG = " ".join(f"Word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "a b\tc", "en", "s", "x", "y"), (2, "abc", None, "s", None, None), (3, None, "en", None, None, None), (4, "", "en", "t", None, None),
    (5, LONG, "en", "s", None, None), (6, LONG + " end", "en", "s", None, None), (7, "▁ odd  spaces ▁▁ 漢字 \U0001f600", "en", "t", None, None), (7, "▁ odd  spaces ▁▁ 漢字 \U0001f600", "en", "t", None, None), (None, "no id here", "en", "t", None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def shingled(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_by_force(rows, percent=85):
    sets = [shingled(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {doc: (len(s), least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets))}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert difference(spark, queries.queries()[name], queries.oracle_sql()[name], SF) == ""


def test_near_copies_by_force(spark):
    d = common.table(spark, SF, "documents").select("doc_id", "text")
    want = near_by_force([tuple(r) for r in d.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.find_near_copies(d).collect()}
    assert got == want
    assert {r.doc_id for r in near_dedup.drop_near_copies(d).collect()} == {k for k, v in want.items() if v[1] == k}


def test_near_radius():
    assert (near_dedup.radius_of(85), near_dedup.radius_of(80)) == (23, 28)
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**16, (300, 64), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(64, 28, replace=False)] ^= 1
    assert (near_dedup.keys_of(a, 28) == near_dedup.keys_of(b, 28)).any(axis=1).all()


def test_chunk_owner_is_the_lowest_shared_key():
    rng = np.random.default_rng(6)
    for radius in (23, 28):
        a = rng.integers(0, 2**16, (60, 64), dtype=np.uint16)
        b = np.where(rng.random((60, 64)) < 0.3, a ^ 1, a).astype(np.uint16)
        same = near_dedup.keys_of(a, radius) == near_dedup.keys_of(b, radius)
        starts = near_dedup.chunk_starts(radius)
        other = a != b
        few = np.add.reduceat(other, starts, axis=1, dtype=np.uint8) <= 1
        assert (few.any(axis=1) == same.any(axis=1)).all()


def family(n, seed, change):
    """n texts of 200 words, each with a share of its words changed at random places."""
    dice = random.Random(seed)
    base = [f"w{seed}_{i}" for i in range(200)]
    return [" ".join(w if dice.random() > change else f"x{seed}_{k}_{i}" for i, w in enumerate(base)) for k in range(n)]


@pytest.mark.parametrize(("block", "many"), [(4096, 32), (32, 16)])
def test_family_of_unlinked_near_pairs(spark, monkeypatch, block, many):
    texts = family(200, 1, 0.02) + family(40, 2, 0.002) + [family(1, 1, 0.0)[0]] * 5 + family(60, 1, 0.006)
    rows = list(enumerate(texts))
    counts, plain = {}, common.written

    def counted(df, name):
        out = plain(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(common, "written", counted)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "MANY", many)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.find_near_copies(df).collect()}
    want = near_by_force(rows)
    assert got == want
    assert 50 < len({c for _, c in want.values()}) < 250
    if block > len(rows):  # else members meet in several groups
        assert counts["near-links"] <= 10 * len(rows) and counts["near-owned"] <= counts["near-members"]


def test_filter_loses_nothing(spark, monkeypatch):
    rows = spark.range(5000).select(F.struct("id", F.xxhash64("id").alias("pick")).alias("doc"), "id")
    wanted = rows.where("id % 9 = 0").select("doc")
    for bitmaps, most in ((2048, 600), (1, 1500)):
        monkeypatch.setattr(near_dedup, "BITMAPS", bitmaps)
        stay = near_dedup._maybe_in(rows, wanted, "doc")
        assert wanted.join(stay, "doc", "left_anti").isEmpty() and stay.columns == rows.columns
        assert stay.count() <= most
    assert near_dedup._maybe_in(rows, wanted.where("false"), "doc").isEmpty()


def test_pipeline_near_copies(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words)] + [" ".join(w if i % 200 not in gone else f"x{k}_{i}" for i, w in enumerate(words)) for k, gone in enumerate(({40, 90, 140, 160}, {30, 60, 90, 120, 150}, set(range(180, 200)), set(range(176, 200))))]
    own = [(10**9 + i, t) for i, t in enumerate(texts)]
    docs = common.table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(own, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    want = {k for k, v in near_by_force(rows, 80).items() if v[1] == k}
    assert want < {k for k, v in near_by_force(rows).items() if v[1] == k}
    assert {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, SF).collect()} == want


def test_near_edge_cases(spark, docs):
    got = {(r.doc_id, r.n_shingles, r.kept) for r in near_dedup.find_near_copies(docs).collect()}
    assert {(3, 0, True), (4, 0, True), (5, 981, True)} <= {(a, b, c) if a != 5 else (5, 981, c) for a, b, c in got}
    assert (6, False) in {(a, c) for a, _, c in got}
    assert near_dedup.drop_near_copies(docs).columns == docs.columns


def test_mix(spark, docs):
    got = mixing.plan(docs).collect()
    assert all(0 <= r.copies <= 3 for r in got) and len(got) == len(ROWS)
    assert sorted(r.copies for r in got) == sorted(r.copies for r in mixing.plan(docs.repartition(3)).collect())
    assert mixing.mix(docs).columns == docs.columns


def test_pieces_round_trip(spark, docs):
    path = sentence_pieces.model_path()
    coded = common.written(sentence_pieces.encode(docs, path), "t")
    back = {r.doc_id: r.text for r in sentence_pieces.decode(coded, path).collect()}
    for doc, text, *_ in ROWS:
        if "▁" not in (text or ""):
            assert back[doc] == (text or "")
    assert back[7] == ROWS[6][1].replace("▁", " ")


def test_chat_round_trip_and_rewriting(spark):
    rows = [(1, 0, "user", "a <|im_end|> \\ n"), (1, 1, "assistant", None), (1, 2, "assistant", "x\n" * 9), (None, 0, None, "q"), (2, 0, "assistant", "assistant"), (2, 0, "assistant", "assistant")] + [(3, i, "assistant", f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    for conv in (1, 2, 3, None):
        own = [r for r in rows if r[0] == conv]
        assert got[conv].n_turns == len(own) and got[conv].rewrites == 0
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256("".join(r[3] or "" for r in own if r[2] == "assistant").encode()).hexdigest()
    last_only = lambda turns: "".join(f"{r}:{t if i == len(turns) - 1 else '-'};" for i, (r, t) in enumerate(turns))
    assert {r.turn: r.rewrites for r in chat_format.format_turns(df.where("conv_id = 1"), last_only).collect()} == {0: False, 1: True, 2: True}
    assert chat_format.format_turns(df.where("false")).count() == 0


def test_chat_refuses_rows_out_of_order(spark):
    df = spark.createDataFrame([(c, i, "assistant", f"text {i}") for c in range(3) for i in range(12)], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="not in order"):
        chat_format.read_back(chat_format.format_turns(df).repartition(3)).collect()


def test_chat_template_sees_whole_history(spark):
    turns = [("system", "s")] + [("user" if i % 2 else "assistant", f"t{i}") for i in range(1, 30)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")

    def late(turns):
        """Numbers its turns, names the first role, and leaves out turn 0's text from turn 12 on."""
        return "".join(f"{turns[0][0]}{i}:{'-' if i == 0 and len(turns) > 12 else t};" for i, (r, t) in enumerate(turns))

    got = chat_format.format_turns(df, late).orderBy("turn").collect()
    assert [r.turn for r in got if r.rewrites] == [12]
    assert [r.span for r in got if not r.rewrites] == [f"system{i}:{t};" for i, (_, t) in enumerate(turns) if i != 12]


def test_repeats(spark):
    passage = " ".join(f"shared{i}" for i in range(60)) + "."
    df = spark.createDataFrame([(1, f"Own start. {passage}"), (2, f"Other start.\n{passage}\nOwn end."), (3, None), (4, "")], "doc_id long, text string")
    (r,) = substring_dedup.find_repeats(df).collect()
    assert r.doc_id == 2 and f"Other start.\n{passage}"[r.start : r.stop] == passage
    assert substring_dedup.remove_repeats(df).columns == df.columns


def repeats_by_force(rows):
    """doc -> places of removed words, by plain sets of pieces seen so far."""
    word = r"[^\x20\x09-\x0D]+"
    low = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    seen, out = {}, {}
    for doc, text in sorted((d, t or "") for d, t in rows):
        places = [(m.start(), low(m[0])) for m in re.finditer(word, text)]
        gone = set()
        for kind, ends in (("line", r"\n"), ("sentence", r"\n|(?<=[.!?])\x20")):
            cuts = [m.start() for m in re.finditer(ends, text)]
            pieces = {}
            for i, (at, w) in enumerate(places):
                pieces.setdefault(bisect.bisect_left(cuts, at), []).append(i)
            run = []
            for own in pieces.values():
                again = not seen.setdefault((kind, tuple(places[i][1] for i in own)), (doc, own[0])) == (doc, own[0])
                if kind == "line" and again:
                    gone.update(own)
                run = run + own if again else []
                if kind == "sentence" and len(run) >= 25:
                    gone.update(run)
        for i in range(len(places) - 49):
            parted = ["\n" in text[places[k][0] : places[k + 1][0]] for k in (i, i + 48)]
            first = seen.setdefault(tuple(w for _, w in places[i : i + 50]), (doc, i, *parted))
            if first[0] != doc or i >= first[1] + 50:
                gone.update(range(i + (parted[0] != first[2]), i + 50 - (parted[1] != first[3])))
        out[doc] = {places[i][0] for i in gone}
    return out


def held_to_force(df):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    texts, got = dict(rows), {d: set() for d, _ in rows}
    for r in substring_dedup.find_repeats(df).collect():
        own = [r.start + m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[r.doc_id][r.start : r.stop])]
        assert len(own) == r.words and not got[r.doc_id] & set(own)
        got[r.doc_id] |= set(own)
    assert got == repeats_by_force(rows)


def test_repeats_cut_anywhere(spark):
    passage = " ".join(f"shared{i}" + "." * (i % 17 == 9) for i in range(70))
    own = lambda k, n: " ".join(f"own{k}_{i}" for i in range(n))
    texts = [f"{own(1, 30)} {passage} {own(2, 9)}.", f"{own(3, 8)} {passage.upper()} {own(4, 8)}\nShort line\n{own(5, 4)}", f"{own(6, 4)}\nshort  line\n{own(7, 4)}", f"{own(8, 3)} {' '.join(passage.split()[7:58])} {own(9, 60)} {own(9, 60)}", f"{own(10, 20)} {' '.join(passage.split()[:49])} {own(11, 3)}", "again " * 160, own(2, 49), own(2, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held_to_force(df)
    gone = {r.doc_id: texts[r.doc_id][r.start : r.stop] for r in substring_dedup.find_repeats(df).collect() if r.doc_id in (2, 3)}
    assert gone[2] == "short  line"
    assert substring_dedup.remove_repeats(df).where("doc_id = 2").head().text == f"{own(6, 4)}\n\n{own(7, 4)}"


def test_repeats_by_force(spark):
    held_to_force(common.table(spark, SF, "documents"))


def test_quality_held_out(spark):
    got = queries.op10_quality_classifier(spark, "/root/testdata/sf0.01").join(common.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").collect()
    right = sum((r.score >= 0.5) == (r.quality == 1) for r in got) / len(got)
    assert right >= 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_edges(spark, docs):
    trees = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.keep_good(docs, trees).count() == len(ROWS)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    for df in (exact_dedup.find_copies(none), exact_dedup.drop_copies(none), near_dedup.find_near_copies(none), near_dedup.drop_near_copies(none), mixing.mix(none), sentence_pieces.encode(none, sentence_pieces.model_path()), substring_dedup.find_repeats(none), secret_scan.find_secrets(none)):
        assert df.count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    got = out.collect()
    want = set(near_by_force([tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]))
    assert got and {r.doc_id for r in got} <= want and all(r.exact for r in got)


def test_growth_on_both_sides_of_many(spark, monkeypatch):
    """Whether a family's keys are first joined by nearest partners or compared at once, no table
    between the steps has more rows than there are (key, member) rows, 64 for a class at most,
    and the classes are the same. (Below that bound a table may grow faster than the family: as
    it grows, a larger share of its members owns a pair.)"""
    plain, counts, classes = common.written, {}, {}

    def counted(df, name):
        out = plain(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(common, "written", counted)
    for many in (32, 1024):
        monkeypatch.setattr(near_dedup, "MANY", many)
        for n in (60, 240):
            counts.clear()
            texts = family(n, 1, 0.02) + family(n // 4, 2, 0.004)
            df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
            classes[many, n] = {r.doc_id: r.component_id for r in near_dedup.find_near_copies(df).collect()}
            assert counts["near-members"] <= near_dedup.PLACES * counts["near-classes"] <= near_dedup.PLACES * len(texts)
            assert max(x for name, x in counts.items() if name != "near-members") <= counts["near-members"], counts
    assert all(classes[32, n] == classes[1024, n] for n in (60, 240))


def test_mix_comes_near_its_targets(spark):
    """A source's taken words are within four deviations of its target: a document's last copy
    is drawn with the fraction f of its rate, which adds f (1 - f) size squared to the variance."""
    rows = queries.op3_mixing(spark, "/root/testdata/sf0.1").groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.sum(F.pow("size", F.lit(2))).alias("squares")).collect()
    for r in rows:
        f = r.target / r.source_size % 1
        assert abs(r.taken - r.target) <= 4 * (f * (1 - f) * r.squares) ** 0.5 + 1, r
    assert len(rows) > 10
