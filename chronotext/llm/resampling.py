"""Resampling of documents towards a target distribution by hashed n-gram importance.

A slice of texts (about SLICE bytes of a partition) becomes a row of word numbers and a
suffix array over them, ordered by the first words up to the longest n-gram. Neighbours that
share n words or more stand for the same n-gram: each such run is hashed once, and its bucket
is scattered back to the places where the n-gram begins. Buckets are counted over all
documents and over the target; a bucket's gain is the log ratio of its smoothed shares, a
document's weight the sum over its n-grams. Documents are drawn without replacement by the
greatest weights plus Gumbel noise that a hash of their ids gives.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common, shingles

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
#: The share of documents to draw, of those with so many words.
PERCENT, LEAST_WORDS = 10, 20
SLICE = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words once A-Z are lowered: digits, a-z and whatever is beyond ASCII.
_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


def numbered_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number of each word, its text, the words by number) of the texts data[at[i]:at[i + 1]]."""
    low = _LOWER[data]
    inside = _INSIDE[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]  # a text's first byte begins a word whatever stands before it
    first[heads] = inside[heads]
    begin = np.flatnonzero(first)
    packed = low[inside]
    cuts = np.append(np.cumsum(inside)[begin] - 1, len(packed)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(cuts), pa.py_buffer(packed)])
    coded = words.dictionary_encode()
    texts = np.searchsorted(at, begin, "right") - 1
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), texts, coded.dictionary.to_pylist()


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of their first depth words, number of words up to depth that a
    place shares with the one before it); left[i] words from place i on are of its text."""
    n = len(ids)
    columns = []
    for j in range(min(depth, n)):
        column = np.full(n, -1, np.int64)
        ok = left[: n - j] > j
        column[: n - j][ok] = ids[j:][ok]
        columns.append(column)
    order = np.lexsort(columns[::-1])
    shared, same = np.zeros(n, np.int64), np.ones(n - 1, bool)
    for column in columns:
        own = column[order]
        same &= (own[1:] == own[:-1]) & (own[1:] >= 0)
        shared[1:] += same
    return order, shared


def gram_buckets(data: np.ndarray, at: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram of 1 to longest words, repeats included."""
    ids, texts, words = numbered_words(data, at)
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = np.searchsorted(texts, texts, "right") - np.arange(n)
    order, shared = suffix_array(ids, left, longest)
    owners, found = [], []
    for size in range(1, longest + 1):
        fresh = shared < size
        heads = order[fresh]
        whole = left[heads] >= size
        run = np.full(len(heads), -1, np.int64)
        run[whole] = [zlib.crc32(b" ".join([words[k] for k in ids[h : h + size].tolist()])) % buckets for h in heads[whole].tolist()]
        own = np.empty(n, np.int64)
        own[order] = run[np.cumsum(fresh) - 1]
        owners.append(texts[own >= 0])
        found.append(own[own >= 0])
    return np.concatenate(owners), np.concatenate(found)


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = shingles.column_bytes(column)
    for i, j in shingles.slices(offsets, SLICE):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """(bucket, n): the n-grams of all docs in each bucket that has any; a task gives buckets
    rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, at in _parts(batch.column("text")):
                total += np.bincount(gram_buckets(data, at, longest, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select(common.text_of(text_col).alias("text"))
    return rows.mapInArrow(common.tidied(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share in target to that in docs, one
    added to each bucket of both; buckets values, so they may come to the driver."""
    s, t = (bucket_counts(x, longest, buckets, text_col).withColumnRenamed("n", name) for x, name in ((docs, "s"), (target, "t")))
    both = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    got = sorted(both.collect())
    s, t = (np.array([r[name] for r in got], np.float64) for name in ("s", "t"))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(id_text: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variable, from a hash of the seed and an id as text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296))).cast("long")


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for i, j, data, at in _parts(batch.column("text")):
                texts, found = gram_buckets(data, at, longest, len(own))
                n = np.bincount(texts, minlength=j - i)
                total = np.bincount(texts, own[found], j - i).astype(np.int64)  # whole numbers far below 2 ** 53
                # a text of w words has w n-grams of one word, w - 1 of two, ...; n tells w
                words = n if longest == 1 else np.bincount(numbered_words(data, at)[1], minlength=j - i)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total)], ["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    kind = StructType([rows.schema["id"]]).add("n_words", "long").add("n_features", "long").add("weight", "long")
    return rows.mapInArrow(common.tidied(run), kind)


def ranked(rows: DataFrame, share: int, order: list[Column]) -> DataFrame:
    """rows, a written table, with rank 1, 2, 3 ... in the given order for the first share
    percent of them, null for the others. Ranges of the order are numbered by themselves and
    shifted by the sizes of those before, which are as many as there are partitions."""
    order = [*order, F.monotonically_increasing_id()]  # equal rows need not meet in one range
    dealt = common.written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "resampling-ranges")
    sizes = sorted(dealt.groupBy("part").count().collect())
    before, at = [], 0
    for part, n in sizes:
        before.append((part, at))
        at += n
    shifts = rows.sparkSession.createDataFrame(before, "part int, shift long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order[:-1])) + F.col("shift")
    numbered = dealt.join(F.broadcast(shifts), "part").withColumn("rank", place.cast("long"))
    return numbered.withColumn("rank", F.when(F.col("rank") <= share * at // 100, F.col("rank"))).drop("part", "shift")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_features, weight, score, rank) of each row of docs; rank is null unless the
    row is drawn: percent of the rows with least_words words or more, by descending score,
    ties to the smaller id.

    A null or empty text has no features and weight 0; a null id counts as an empty one in the
    noise and comes last among ties. Rows are independent: repeated ids and texts are each
    ranked. Texts are read whole, a long one as a slice of its own. An empty table gives no
    rows, an empty target weighs down what is frequent in docs. Other columns are ignored."""
    gain = gains(docs, target, longest, buckets, text_col)
    rows = weights(docs, gain, longest, id_col, text_col)
    rows = common.written(rows.withColumn("score", F.col("weight") + noise(F.col("id").cast("string"), seed)), "resampling-scores")
    able = F.col("n_words") >= least_words
    drawn = ranked(rows.where(able), percent, [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("weight")])
    rest = rows.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn rows of docs with all their columns; ids must be unique here."""
    drawn = resample(docs, target, percent, id_col=id_col, text_col=text_col).where("rank is not null").select(id_col)
    return docs.join(drawn, id_col, "left_semi").select(docs.columns)
