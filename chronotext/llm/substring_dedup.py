"""Substring deduplication by hashing of lines, sentences and word windows.

Words are compared with A-Z as a-z, whatever white space is between them. Of equal pieces the
occurrence of the lowest rank is kept: smallest document id (null last), then smallest
offset. Every other occurrence repeats it and goes if it is

* a line, of any length (so a paragraph that is repeated goes line by line),
* a run of sentences (cut at line ends and after [.!?] and a blank) that are all repeats,
  with at least ``least_words`` words together, or
* a window of PASSAGE words, wherever it is cut. Overlapping windows join, so a longer
  passage goes up to its exact word borders. One word at a window's edge stays if a line
  break parts it from the window in only one of the two texts. A window that overlaps its own
  kept occurrence stays.

Windows are not compared for every word of the corpus: of the GRAM-word hashes in a window the
least is its anchor, and equal windows have equal anchors. Anchors are about one in 16 words;
only windows with an anchor that occurs twice are written and compared, all of them. A text
that is equal to one of a lower rank takes no part in this: its lines go anyhow, and each of
its windows has an occurrence of a lower rank.

Digests are partially aggregated before the shuffle, so a passage that a third of all
documents share is one row per task; the lookups of ranks join two tables read from files,
so that adaptive execution can split a hot digest. Texts are shuffled once, to bring them
their anchors. Removed runs carry their offsets in the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, shingles

#: A run of repeated sentences that is removed has at least so many words.
LEAST_WORDS = 25
#: Words of a window, and of the pieces of it whose least hash is its anchor.
PASSAGE, GRAM = 50, 20
SENTENCE, LINE, ANCHOR = 0, 1, 2
_rng = np.random.default_rng(31)
_BASES = [np.uint64(int(x) * 2 + 1) for x in _rng.integers(0, 2**62, 2)]
_BACKS = [np.uint64(pow(int(x), -1, 2**64)) for x in _BASES]
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?"])

UNITS = "id long, uid long, kind int, w int, words int, at int, stop int, hi long, lo long"
WINDOWS = "id long, uid long, w int, words int, at int, stop int, hi long, lo long, at_second int, stop_second int, breaks int"


class Words:
    """The words of the texts in data that begin at the offsets at."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.begin, self.end, words = data, *shingles.word_hashes(data, at)
        self.n = len(words)
        self.text = np.searchsorted(at, self.begin, "right") - 1
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        self.at = points[self.begin] - points[at[self.text]]
        self.stop = points[self.end + 1] - points[at[self.text]]
        self.bounds = np.searchsorted(self.begin, at)
        self.place = np.arange(self.n) - self.bounds[self.text]
        with np.errstate(over="ignore"):
            self.sums = [np.concatenate(([np.uint64(0)], np.cumsum(words * shingles._power(base, self.n, name), dtype=np.uint64))) for name, base in zip(("hi", "lo"), _BASES)]

    def digest(self, k: int, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Digest k of count words from the word first on."""
        with np.errstate(over="ignore"):
            own = (self.sums[k][first + count] - self.sums[k][first]) * shingles._power(_BACKS[k], self.n, f"{('hi', 'lo')[k]}_back")[first]
            return shingles.mixed(own + count.astype(np.uint64))

    def pieces(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number of words) of the pieces of texts that ends (of bytes) cut."""
        before = np.cumsum(ends)[self.begin]
        fresh = np.ones(self.n, bool)
        fresh[1:] = (before[1:] != before[:-1]) | (self.text[1:] != self.text[:-1])
        first = np.flatnonzero(fresh)
        return first, np.diff(np.append(first, self.n))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows, their anchors, places of anchors): first words of the windows that lie
        within a text, the least hash in each, and all words where such a hash begins."""
        none = np.empty(0, np.int64)
        n, width = self.n - GRAM + 1, PASSAGE - GRAM + 1
        if self.n < PASSAGE:
            return none, none.astype(np.uint64), none
        grams = self.digest(0, np.arange(n), np.full(n, GRAM))
        least = _sliding(np.minimum, grams, width)
        inside = np.arange(len(least)) + PASSAGE <= self.bounds[self.text[: len(least)] + 1]
        # a hash is an anchor if it is the least of a window that it lies in
        padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
        padded[width - 1 : width - 1 + len(least)] = np.where(inside, least, np.uint64(0))
        most = _sliding(np.maximum, padded, width)
        windows = np.flatnonzero(inside)
        return windows, least[windows], np.flatnonzero((most == grams) & (grams > 0))


def _sliding(least: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """least (or most) of x[i : i + width] for each i."""
    have = 1
    out, n = x, len(x) - width + 1
    while have < width:
        step = min(have, width - have)
        out = least(out[:-step], out[step:])
        have += step
    return out[:n]


def _batch(kind: str, ids, uids, words: Words, first, count, before=(), after=()) -> pa.RecordBatch:
    """Pieces of words as rows of a kind, with further columns before w and at the end; ids
    and uids are those of the slice's texts."""
    text = words.text[first]
    digests = [words.digest(0, first, count), words.digest(1, first, count)]
    ints = [words.place[first], count, words.at[first], words.stop[first + count - 1]]
    cols = [ids.take(pa.array(text)), pa.array(uids[text]), *[pa.array(x, pa.int32()) for x in (*before, *ints)], *[pa.array(x.view(np.int64)) for x in digests], *[pa.array(x, pa.int32()) for x in after]]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in kind.split(", ")])


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words]]:
    data, offsets = shingles.column_bytes(batch.column("text"))
    for i, j in shingles.slices(offsets):
        if offsets[i] < offsets[j]:
            yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, uids = batch.column("id"), batch.column("uid").to_numpy()
        for i, j, words in _sliced(batch):
            if not words.n:
                continue
            own = ids.slice(i, j - i), uids[i:j], words
            lines = words.data == 10
            sentences = lines.copy()
            sentences[1:] |= (words.data[1:] == 32) & _ENDS[words.data[:-1]]
            for kind, ends in ((SENTENCE, sentences), (LINE, lines)):
                first, count = words.pieces(ends)
                yield _batch(UNITS, *own, first, count, [np.full(len(first), kind)])
            _, _, at = words.anchors()
            hi = words.digest(0, at, np.full(len(at), GRAM)).view(np.int64)
            known = {"uid": pa.array(own[1][words.text[at]]), "kind": pa.array(np.full(len(at), ANCHOR), pa.int32()), "hi": pa.array(hi)}
            names = [c.split() for c in UNITS.split(", ")]
            yield pa.RecordBatch.from_arrays([known[n] if n in known else pa.nulls(len(at), pa.int64() if t == "long" else pa.int32()) for n, t in names], [n for n, _ in names])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of texts whose anchors are among ``anchors``."""
    for batch in batches:
        ids, uids, anchors = batch.column("id"), batch.column("uid").to_numpy(), batch.column("anchors")
        for i, j, words in _sliced(batch):
            windows, least, _ = words.anchors()
            wanted = anchors.slice(i, j - i).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            first = windows[np.isin(least, wanted)]
            line = np.cumsum(words.data == 10)[words.begin]
            parted = (line[1:] != line[:-1]).astype(np.int64)
            for k in range(0, len(first), 1 << 16):
                part = first[k : k + (1 << 16)]
                last = part + PASSAGE - 1
                edges = [words.at[part + 1], words.stop[last - 1], parted[part] + 2 * parted[last - 1]]
                yield _batch(WINDOWS, ids.slice(i, j - i), uids[i:j], words, part, np.full(len(part), PASSAGE), after=edges)


def _later(pieces: DataFrame, on: list[str], name: str, more: tuple[str, ...] = ()) -> DataFrame:
    """The pieces that repeat one of a lower rank, without those that overlap it, with the
    columns more of that one as kept_..."""
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "uid", "w", *more)
    digests = pieces.groupBy(*on).agg(F.count(F.lit(1)).alias("seen"), F.min(rank).alias("kept")).where("seen > 1")
    known = common.written(digests.select(*on, F.col("kept.uid").alias("kept_uid"), F.col("kept.w").alias("kept_w"), *[F.col(f"kept.{c}").alias(f"kept_{c}") for c in more]), name)
    return pieces.join(known, on).where("uid <> kept_uid or w >= kept_w + words").drop("kept_uid", "kept_w")


def _joined(spans: DataFrame) -> DataFrame:
    """Spans of words (w, words, at, stop, units) of each uid, joined where they overlap or
    follow each other."""
    before = Window.partitionBy("uid").orderBy("w", "words")
    reach = F.max(F.col("w") + F.col("words")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.when(F.col("w") <= reach, 0).otherwise(1))
    runs = fresh.withColumn("run", F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.max(F.col("w") + F.col("words")) - F.min("w")
    return runs.groupBy("uid", "run").agg(F.first("id").alias("id"), F.min("w").alias("w"), words.alias("words"), F.min("at").alias("at"), F.max("stop").alias("stop"), F.sum("units").alias("units")).drop("run")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, uid_col: str | None = None) -> DataFrame:
    """The removed runs: id_col, uid, start, stop (code points of the original text, stop
    exclusive), words, units (repeated sentences in it; 0 if none is repeated whole). uid
    tells rows apart, also rows of equal ids: it is the column uid_col if given, else made
    here.

    Of rows with equal ids the one with the smaller uid ranks first. Null, empty and blank
    texts have no words. Repeats within a text count as any other. An empty table and a
    table without repeats give no rows."""
    uid = F.monotonically_increasing_id() if uid_col is None else F.col(uid_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), uid.alias("uid"), common.text_of(text_col).alias("text"))
    if uid_col is None:
        rows = common.written(rows, "repeat-texts")
    units = common.written(rows.mapInArrow(_units, UNITS), "units")
    span = ["id", "uid", "w", "words", "at", "stop"]
    pieces = common.written(_later(units.where(F.col("kind") != ANCHOR), ["kind", "hi", "lo"], "unit-digests").select("kind", *span), "unit-repeats")
    texts = rows.select("id", "uid", F.md5(F.col("text").cast("binary")).alias("md5"), F.lit(0).alias("w"), F.lit(1).alias("words"))
    copies = common.written(_later(texts, ["md5"], "text-digests").select("uid"), "text-copies")
    anchors = units.where(F.col("kind") == ANCHOR).select("uid", "hi").join(copies, "uid", "left_anti")
    anchors = common.written(anchors, "anchors")
    common.forget(units, copies)
    sentences = pieces.where(F.col("kind") == SENTENCE).select(*span, F.lit(1).cast("long").alias("units"))
    lines = pieces.where(F.col("kind") == LINE).select(*span, F.lit(0).cast("long").alias("units"))
    runs = common.written(_joined(_joined(sentences).where(F.col("words") >= least_words).select(*span, "units").unionByName(lines)).select(*span, "units"), "unit-runs")
    common.forget(pieces)

    twice = common.written(anchors.groupBy("hi").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1").select("hi"), "anchor-digests")
    wanted = common.written(anchors.join(twice, "hi").groupBy("uid").agg(F.collect_set("hi").alias("anchors")), "anchor-lists")
    common.forget(anchors, twice)
    windows = common.written(rows.join(wanted, "uid").select("id", "uid", "text", "anchors").mapInArrow(_windows, WINDOWS), "windows")
    common.forget(wanted, rows if uid_col is None else None)
    passages = _later(windows, ["hi", "lo"], "window-digests", ("breaks",))
    other = F.col("breaks").bitwiseXOR(F.col("kept_breaks"))
    head, tail = other.bitwiseAND(F.lit(1)), F.shiftright(other, 1)
    at, stop = F.when(head == 1, F.col("at_second")).otherwise(F.col("at")), F.when(tail == 1, F.col("stop_second")).otherwise(F.col("stop"))
    passages = passages.select("id", "uid", (F.col("w") + head).alias("w"), (F.col("words") - head - tail).alias("words"), at.alias("at"), stop.alias("stop"), F.lit(0).cast("long").alias("units"))
    passages = common.written(passages, "window-repeats")
    common.forget(windows)
    found = _joined(runs.unionByName(passages))
    return found.select(F.col("id").alias(id_col), "uid", F.col("at").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("words").cast("long").alias("words"), "units")


def _without(text: Column, spans: Column) -> Column:
    """text without spans (start, stop), which are in order and do not overlap."""
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["stop"]))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    kept = F.zip_with(starts, stops, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.array_join(kept, "")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with the removed runs cut out of their texts, all other columns and rows as they
    were. White space around a removed run stays. A text that is all repeats becomes empty
    or blank."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = common.written(rows.withColumn("uid", F.monotonically_increasing_id()), "repeat-rows")
    flat = rows.select("uid", F.col("row").getField(id_col).alias("id"), F.col("row").getField(text_col).alias("text"))
    runs = find_repeats(flat, "id", "text", least_words, "uid").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    text = F.col("row").getField(text_col)
    cleaned = F.when(F.col("spans").isNull(), text).otherwise(_without(text, F.col("spans")))
    fields = [cleaned.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return rows.join(runs, "uid", "left").select(*fields)
