"""Exact deduplication over an extendible-hash index that lies in shared files.

A text's 64-bit hash addresses a bucket by its leading bits. The directory has an entry for
each cell of CELL_BITS leading bits with the depth of its buckets, that is how many bits tell
them apart. All cells begin as one bucket; in each round every bucket that holds more than
``capacity`` distinct hash values is split by one more bit, which doubles its part of the
directory. (Splits below CELL_BITS are counted on the cells alone.) A bucket whose records
are many because rows repeat can't be split by bits: it gets more pages instead.

Rows are dealt to the pages of their bucket, and the task that owns a page chains the rows of
equal hash, tells them apart by the bytes of their texts and keeps a record for each distinct
text. The owners write these to shared files, ordered by bucket; the pages of a bucket are
then folded, and every row is looked up in its bucket. Nothing else says which texts are equal.

Only DataFrame operations are used. A hot text is spread over as many pages as it fills, and
each page folds it to one record; the lookup joins two freshly read tables, so that adaptive
execution can split a hot bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The directory has at most 2**CELL_BITS entries, about 1 MB: safe to broadcast.
CELL_BITS = 16
#: Distinct hash values of a bucket, and rows of a page.
CAPACITY, PAGE = 4096, 8192


def _cell(bits: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - bits)


def bucket_of(hash_: Column, depth: Column) -> Column:
    """Depth and the leading ``depth`` bits (0 to 63), as one name."""
    return F.concat_ws("-", depth.cast("string"), F.when(depth == 0, F.lit("0")).otherwise(F.conv(F.hex(F.call_function("shiftrightunsigned", hash_, F.lit(64) - depth)), 16, 10)))


def directory(hashes: DataFrame, capacity: int = CAPACITY, bits: int = CELL_BITS, rounds: list | None = None) -> DataFrame:
    """cell -> depth for the cells that occur, at most 2**bits rows; hashes has a row for each
    distinct hash value. rounds, if given, collects the depths at which buckets were split."""
    cells = common.written(hashes.groupBy(_cell(bits).alias("cell")).agg(F.count(F.lit(1)).alias("n")), "exact-cells")
    # up to the cells' own bits: the shortest prefix that fits
    levels = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")
    paths = cells.select("cell", "n", levels).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    fits = paths.groupBy("depth", "prefix").agg(F.sum("n").alias("held")).where((F.col("held") <= capacity) | (F.col("depth") == bits))
    leaf = paths.join(F.broadcast(fits.select("depth", "prefix")), ["depth", "prefix"])  # 2**(bits + 1) rows at most
    known = common.written(leaf.groupBy("cell").agg(F.min("depth").alias("depth")), "exact-directory")
    # beyond them: rounds that split the overfull cells by one more bit each
    full = cells.where(F.col("n") > capacity).select("cell")
    deeper = common.written(hashes.withColumn("cell", _cell(bits)).join(F.broadcast(full), "cell"), "exact-overfull")
    depth = bits
    while depth < 63:
        held = deeper.groupBy("cell", F.shiftrightunsigned("hash", 64 - depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        over = common.written(held.where(F.col("n") > capacity).select("cell").distinct(), "exact-split")
        if over.isEmpty():
            break
        if rounds is not None:
            rounds.append(depth)
        depth += 1
        split = over.withColumn("deeper", F.lit(depth))
        known = common.written(known.join(F.broadcast(split), "cell", "left").select("cell", F.coalesce("deeper", "depth").alias("depth")), "exact-directory")
    return known


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = common.text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.length(text).cast("long").alias("points"), common.without_spaces(text).alias("norm"))
    return rows.withColumn("hash", F.xxhash64("norm"))


def _addressed(rows: DataFrame, entries: DataFrame, bits: int) -> DataFrame:
    return rows.withColumn("cell", _cell(bits)).join(F.broadcast(entries), "cell").withColumn("bucket", bucket_of(F.col("hash"), F.col("depth"))).drop("cell", "depth")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, page: int = PAGE, bits: int = CELL_BITS, rounds: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(index, directory), both read from files in the shared folder. The index has a record
    for each distinct text: bucket, hash, text_sha256, keep_id, keep_points, group_size."""
    rows = _rows(docs, id_col, text_col)
    hashes = common.written(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "exact-hashes")
    entries = directory(hashes.select("hash"), capacity, bits, rounds)
    # pages: only for hash values that fill more than one, so they are few
    hot = common.written(hashes.where(F.col("n") > page).select("hash", F.ceil(F.col("n") / page).cast("int").alias("pages")), "exact-hot")
    dealt = _addressed(rows, entries, bits).join(hot, "hash", "left")
    dealt = dealt.withColumn("page", F.coalesce(F.pmod(F.xxhash64("id", "points"), F.col("pages")), F.lit(0)).cast("int")).drop("pages")
    best = F.min(F.struct((-F.col("points")).alias("minus"), F.col("id").isNull().alias("no_id"), "id"))
    # the owner of a page groups its rows by hash and bytes: both groupings need no other shuffle
    owned = dealt.repartition("bucket", "page").groupBy("bucket", "page", "hash", "norm").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    pages = common.written(owned.select("bucket", "hash", F.sha2("norm", 256).alias("text_sha256"), "best", "n").sortWithinPartitions("bucket", "hash"), "exact-pages")
    index = pages.groupBy("bucket", "hash", "text_sha256").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    index = index.select("bucket", "hash", "text_sha256", F.col("best.id").alias("keep_id"), (-F.col("best.minus")).alias("keep_points"), "group_size")
    index = common.written(index.sortWithinPartitions("bucket", "hash"), "exact-index")
    common.forget(hashes, pages)
    return index, entries


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, page: int = PAGE, bits: int = CELL_BITS) -> DataFrame:
    """A row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical without white space; null counts as empty, and empty texts
    are copies of each other. Of a group the row with the most code points in its original
    text stays, then the smallest id (null after all others). Rows that repeat the kept id
    are all marked kept; ``drop_copies`` leaves one of them. An empty table gives none.
    Columns other than the two named are ignored, whatever their names."""
    index, entries = build_index(docs, id_col, text_col, capacity, page, bits)
    rows = _rows(docs, id_col, text_col).select("id", "points", "hash", F.sha2("norm", 256).alias("text_sha256"))
    found = _addressed(rows, entries, bits).join(index, ["bucket", "hash", "text_sha256"])
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, page: int = PAGE, bits: int = CELL_BITS) -> DataFrame:
    """docs without copies, all columns kept: one row of each group of equal texts.

    The kept rows are looked up in their bucket by hash, digest, id and length; rows that
    agree in all of these (repeats of one row) are folded into one."""
    index, entries = build_index(docs, id_col, text_col, capacity, page, bits)
    text = common.text_of(text_col)
    norm = common.without_spaces(text)
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.xxhash64(norm).alias("hash"),
        F.sha2(norm, 256).alias("sha"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"),
        F.col(id_col).isNull().alias("no_id"),
        F.length(text).cast("long").alias("points"),
    )
    keys = ["bucket", "hash", "sha", "key", "no_id", "points"]
    keep = index.select("bucket", "hash", F.col("text_sha256").alias("sha"), F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias("key"), F.col("keep_id").isNull().alias("no_id"), F.col("keep_points").alias("points"))
    return _addressed(rows, entries, bits).join(keep, keys, "left_semi").dropDuplicates(keys).select("row.*")
