"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The trees are fitted on at most SAMPLE labelled rows, chosen by a hash of their ids: their
statistics come to the driver, a few MB at most, and features are put into BINS bins at
quantiles, so that a split is a sum over a histogram. All trees have the same depth and lie
in three arrays; a batch of documents walks all trees at once, a level at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from . import common

#: Documented bound of the labelled rows that are used for fitting.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, SMOOTH, LEAST_WEIGHT = 120, 4, 0.1, 64, 1.0, 2.0
THRESHOLD = 0.7
SLICE = 1 << 20

FEATURES = (
    "characters", "upper", "digits", "spaces", "line_ends", "other_letters", "marks", "signs", "sign_kinds", "sign_share_of_marks", "byte_entropy",
    "words", "word_length", "word_length_spread", "longest_word", "distinct_words", "top_word", "one_letter_words", "signed_words", "capital_words", "repeats_in_a_row",
    "distinct_pairs", "lines", "line_length", "repeated_lines", "short_lines", "ended_lines", "lines_with_bars",
)
_MARKS = np.isin(np.arange(256), [ord(c) for c in ".,;:!?'\"()-"])
_SIGNS = np.isin(np.arange(256), [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"])
_ENDS = (".", "!", "?", '"', "'", ":", ";", ")")


def statistics(text: str) -> list[float]:
    """FEATURES of a text; all 0 if it is empty."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = text.split()
    if not len(raw) or not words:
        return [float(len(text)), *[0.0] * (len(FEATURES) - 1)]
    n, w = len(raw), len(words)
    counts = np.bincount(raw, minlength=256)
    share = counts[counts > 0] / n
    marks, signs = int(counts[_MARKS].sum()), int(counts[_SIGNS].sum())
    lengths = np.fromiter(map(len, words), np.int64, w)
    seen = Counter(words)
    pairs = set(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    m = len(lines)
    upper = int(counts[65:91].sum())
    return [
        float(len(text)), upper / n, int(counts[48:58].sum()) / n, int(counts[32]) / n, int(counts[10]) / n, int(counts[128:].sum()) / n, marks / n, signs / n, float((counts[_SIGNS] > 0).sum()), signs / (marks + signs + 1), float(-(share * np.log2(share)).sum()),
        float(w), float(lengths.mean()), float(lengths.std()), float(lengths.max()), len(seen) / w, max(seen.values()) / w, int((lengths == 1).sum()) / w, sum(1 for x in words if not x[-1].isalnum() and x[-1] not in ".,;:!?'\"") / w, sum(1 for x in words if x.isupper()) / w, sum(1 for a, b in pairs if a == b) and sum(1 for a, b in zip(words, words[1:]) if a == b) / w,
        (len(pairs) + 1) / w, float(m), n / m, 1 - len(set(lines)) / m, sum(1 for x in lines if len(x) < 30) / m, sum(1 for x in lines if x.rstrip().endswith(_ENDS)) / m, sum(1 for x in lines if "|" in x) / m,
    ]


@dataclass
class Trees:
    """features[t, i] and cuts[t, i] of inner node i of tree t (children 2i + 1, 2i + 2), and
    leaves[t, j]; the score is the logistic of base plus a leaf of each tree."""

    base: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.features):
            at = np.zeros((len(x), len(self.features)), np.int64)
            tree = np.arange(len(self.features))
            row = np.arange(len(x))[:, None]
            for _ in range(DEPTH):
                right = x[row, self.features[tree, at]] > self.cuts[tree, at]
                at = 2 * at + 1 + right
            total += self.leaves[tree, at - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for labels 0 and 1. Without rows every score is near 1: nothing is
    rejected without evidence; with one label only, scores are near that label."""
    inner, n = 2**DEPTH - 1, len(y)
    if not n or y.min() == y.max():
        p = 0.999 if not n or y[0] else 0.001
        return Trees(math.log(p / (1 - p)), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    base = math.log(y.mean() / (1 - y.mean()))
    total = np.full(n, base)
    features, cuts, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            best = np.zeros(nodes)
            node = at - first
            split = np.full(nodes, -1)
            place = np.zeros(nodes, np.int64)
            for f in range(x.shape[1]):
                slot = node * BINS + binned[:, f]
                gs = np.bincount(slot, g, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                hs = np.bincount(slot, h, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + SMOOTH) + (gt - gs) ** 2 / (ht - hs + SMOOTH) - gt**2 / (ht + SMOOTH)
                gain[(hs < LEAST_WEIGHT) | (ht - hs < LEAST_WEIGHT)] = 0
                gain = gain[:, : len(edges[f])]
                if gain.shape[1]:
                    b = gain.argmax(axis=1)
                    top = gain[np.arange(nodes), b]
                    better = top > best + 1e-9
                    best[better], split[better], place[better] = top[better], f, b[better]
            for k in np.flatnonzero(split >= 0):
                feature[first + k], cut[first + k] = split[k], edges[split[k]][place[k]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = -RATE * gs / (hs + SMOOTH)
        total += value[leaf]
        features.append(feature)
        cuts.append(cut)
        leaves.append(value)
    return Trees(base, np.array(features), np.array(cuts), np.array(leaves))


def held_out(doc_id) -> object:
    """Whether a row is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _texts(column: pa.Array) -> pa.Array:
    return pc.fill_null(column, "")


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes, i = pc.binary_length(texts).to_pylist(), 0
    while i < len(sizes):
        j, held = i, 0
        while j < len(sizes) and (j == i or held + sizes[j] <= SLICE):
            held += sizes[j]
            j += 1
        yield i, j
        i = j


def _measured(texts: pa.Array) -> np.ndarray:
    texts = _texts(texts)
    return np.array([statistics(t) for i, j in _slices(texts) for t in texts.slice(i, j - i).to_pylist()]).reshape(-1, len(FEATURES))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _measured(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "label", "features"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees fitted on labelled rows of docs that aren't held out, sample of them at most.

    Rows of labels without id or label are ignored, labels of the same id are averaged;
    rows of docs with the same id count once."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    measured = rows.mapInArrow(common.tidied(_measure), StructType([rows.schema["id"]]).add("label", "integer").add("features", ArrayType(DoubleType())))
    got = measured.groupBy("id").agg(F.min("features").alias("features"), F.min("label").alias("label")).orderBy("id").collect()
    x = np.array([r["features"] for r in got]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["label"] for r in got], float))


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of each row of docs; null texts are scored as empty ones. Rows are
    independent, so ids may repeat or be null. An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(trees.score(_measured(batch.column("text"))))], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(common.tidied(run), StructType([rows.schema["id"]]).add("score", "double")).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, trees: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores at least threshold, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.struct_field(batch.column("row"), [text_at])
            yield batch.filter(pa.array(trees.score(_measured(texts)) >= threshold))

    text_at = docs.columns.index(text_col)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return rows.mapInArrow(common.tidied(run), rows.schema).select("row.*")
