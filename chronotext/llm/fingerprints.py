"""Document fingerprints: threshold-scaled sketches of word shingles.

Of the 48-bit hashes of a text's shingles a fingerprint keeps every one below 1 / SCALE of
their range, and the smallest in any case, so that short texts have one too. The sketch of
a union is the union of sketches (and the smaller of the smallest), so sketches can be
merged; equal fractions of both sides are kept, so containment can be estimated between
texts of very unequal lengths.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common, shingles

SCALE = 4
BITS = 48
_BELOW = np.uint64((1 << BITS) // SCALE)


def sketch(own: np.ndarray) -> np.ndarray:
    """Hashes to keep, ascending, of a text's distinct 48-bit hashes in ascending order."""
    return own[: max(1, int(np.searchsorted(own, _BELOW)))]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """A sketch of each text."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(np.int64)
    found, counts = shingles.hashes(np.frombuffer(b"".join(data), np.uint8), offsets)
    found, counts = shingles.distinct(found >> np.uint64(64 - BITS), counts)
    cuts = np.concatenate(([0], np.cumsum(counts)))
    return [sketch(found[a:b]) for a, b in zip(cuts, cuts[1:])]


def written_as(kept: np.ndarray) -> str:
    """12 hex digits for each hash, in ascending order; empty for a text without words."""
    return kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def read_from(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 6)
    return np.concatenate((np.zeros((len(raw), 2), np.uint8), raw), axis=1).reshape(-1).view(">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts together: hashes of either below the threshold, or the least."""
    return sketch(np.union1d(a, b)) if len(a) or len(b) else a


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(similarity, containment of a in b), each from 0 to 1.

    Two texts without words are alike (1, 1); one without words is like no other (0, 0).
    Hashes above the threshold, which only short texts keep, count if neither side has any
    below it."""
    if not len(a) or not len(b):
        same = float(len(a) == len(b))
        return same, same
    if a[0] < _BELOW or b[0] < _BELOW:
        a, b = a[a < _BELOW], b[b < _BELOW]
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both), both / len(a) if len(a) else 0.0


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, offsets = shingles.column_bytes(batch.column("text"))
        out = []
        for i, j in shingles.slices(offsets):
            out += [written_as(s) for s in sketches(batch.column("text").slice(i, j - i).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "fingerprint"])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) of each row of docs; equal texts have equal fingerprints.

    A null or blank text has an empty fingerprint. Ids may repeat or be null. An empty
    table gives no rows; columns other than the two named are ignored."""
    rows = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    out = rows.mapInArrow(_fingerprint, StructType([rows.schema["id"]]).add("fingerprint", "string"))
    return out.withColumnRenamed("id", id_col)


#: Documents in a range, about; ranges are dealt to tasks.
RANGE_ROWS = 5_000
MOST_RANGES = 20_000


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, ghost, id, text), rows of a part to be read by ghost, then descending id: the
    row after a row holds the next document, and a part's last row, its ghost, is the first
    document of the part that follows (after the last part: of the first one).

    Parts are ranges of ids, cut at quantiles, of which the driver sees at most MOST_RANGES;
    texts are shuffled once. A null id comes last; rows of equal ids are ordered by text. Ids
    are whole numbers; others are refused, as no order of theirs is agreed upon."""
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}, not a whole number")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text"))
    ids = rows.select("id", (-F.col("id").cast("double")).alias("place"))
    ranges = int(min(MOST_RANGES, max(2, ids.count() // RANGE_ROWS)))
    cuts = ids.select(F.percentile_approx("place", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or [0.0]  # no ids, one cut
    bounds = [-math.inf, *sorted(set(cuts)), math.inf]
    parted = Bucketizer(splits=bounds, inputCol="place", outputCol="bucket", handleInvalid="keep")
    part = F.coalesce("bucket", F.lit(len(bounds))).cast("int").alias("part")

    firsts = parted.transform(ids).groupBy(part).agg(F.max("id").alias("id")).orderBy("part").collect()
    parts = [r["part"] for r in firsts]
    ghosts = spark.createDataFrame([(r["id"], p) for r, p in zip(firsts, [parts[-1], *parts[:-1]] if parts else [])], "ghost_id long, ghost_part int")
    heads = rows.join(F.broadcast(ghosts), F.col("id").eqNullSafe(F.col("ghost_id"))).groupBy("ghost_part").agg(F.min(F.struct("text", "id")).alias("h"))
    ghost_rows = heads.select(F.col("ghost_part").alias("part"), F.lit(1).alias("ghost"), F.col("h.id").alias("id"), F.col("h.text").alias("text"))
    own = parted.transform(rows.withColumn("place", -F.col("id").cast("double"))).select(part, F.lit(0).alias("ghost"), "id", "text")
    return own.unionByName(ghost_rows).repartition("part").sortWithinPartitions("part", "ghost", F.col("id").desc_nulls_last(), "text")


def edited(text: str, after: str) -> str:
    """text with its last half replaced by the first as many characters of after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


COMPARED = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = None  # the row before: (id, text, sketch), none after a ghost
    for batch in batches:
        _, offsets = shingles.column_bytes(batch.column("text"))
        for i, j in shingles.slices(offsets):
            ghosts, ids, texts = (batch.column(c).slice(i, j - i).to_pylist() for c in ("ghost", "id", "text"))
            rows = [*([before] if before else []), *zip(ids, texts, sketches(texts))]
            ends = [*([0] if before else []), *ghosts]
            pairs = [(a, b) for a, b, end in zip(rows, rows[1:], ends) if not end]
            before = None if ends[-1] else rows[-1]
            made = [edited(a[1], b[1]) for a, b in pairs]
            out = []
            for (a, b), text, own in zip(pairs, made, sketches(made) if made else []):
                near, inside = likeness(a[2], own)
                near_next, inside_next = likeness(a[2], b[2])
                digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((a[0], len(a[1]), digest, written_as(a[2]), written_as(own), near, near_next, inside, inside_next))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4])], COMPARED_NAMES)


COMPARED_NAMES = [c.split()[0] for c in COMPARED.split(", ")]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each row's text and of its text edited with the next document, and
    their likeness; see with_next for the order. A sole document is its own next one; an
    empty table gives no rows."""
    return with_next(docs, id_col, text_col).select("ghost", "id", "text").mapInArrow(_compare, COMPARED).withColumnRenamed("id", id_col)
