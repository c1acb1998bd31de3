"""MinHash near-deduplication by a multi-index Hamming join of b-bit signatures.

1. Every text's set of word shingles gives a signature of PLACES symbols of 16 bits each
   (the low bits of its minimum under PLACES hash functions) and a digest of the set.
   Documents with equal sets form a class and go on as one.
2. Signatures at a distance (number of unequal symbols) of at most a radius are wanted. They
   are split into radius // 2 + 1 chunks; by the pigeonhole principle such a pair has a chunk
   with at most one unequal symbol. So each chunk gives a key for each of its
   symbols left out, PLACES keys in all, and every such pair meets under some key.
3. Keys of many members come first: within blocks of a bounded size each member yields its
   nearest partner; these pairs are confirmed on full sets and joined to components, and in
   keys beyond one block one member of each component goes on to a further round.
4. Then all keys that still hold several components are searched for pairs across them. A
   pair is owned by the lowest key that it shares, and only the members of owned pairs go
   on, with their full sets, to the task that owns the key. It confirms pairs on these sets,
   joins what is linked at once, and gives one link for each join: fewer than it has members.
   So no key gives all its pairs, and no link that joins two components is missed.

The radius follows from percent: at just that similarity the distance is binomial and exceeds
it with a chance of at most MISSED (23 of 64 for 85 percent, 28 for 80); everything else is
exact. Only keys, signatures and candidates' sets are
shuffled; of each class that is a candidate one text is, and those others that a filter of
a fixed size lets through: few as long as it isn't full, all once it is.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import common, shingles
from .components import components

PLACES, MISSED = 64, 1e-5
#: Members of a key are compared in blocks of about this many at most; a member of SHINGLES
#: shingles counts as two, so a block's sets are bounded too.
BLOCK, SHINGLES = 4096, 512
#: Keys of more members are first joined to components by nearest partners; all pairs of the
#: members of smaller ones are compared at once.
MANY = 1024
#: Pairs that are compared at once.
PAIRS = 1 << 16
#: Bitmaps of the filter that keeps texts of no candidate out of the shuffle, 4 KiB each: 8 MiB
#: at any size of the input. A full filter lets all texts through; the join decides.
BITMAPS, BITS = 2048, 32_768

_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 2**64, PLACES, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = _rng.integers(0, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(0, 2**64, PLACES, dtype=np.uint64)


@functools.cache
def radius_of(percent: int) -> int:
    """The least distance that a pair at this similarity exceeds with a chance of at most MISSED."""
    p = percent / 100
    chance = [math.comb(PLACES, k) * (1 - p) ** k * p ** (PLACES - k) for k in range(PLACES + 1)]
    return next(r for r in range(PLACES + 1) if math.fsum(chance[r + 1 :]) <= MISSED)


def chunk_starts(radius: int) -> np.ndarray:
    """The first place of each chunk."""
    return np.flatnonzero(np.diff(np.sort(np.arange(PLACES) % (radius // 2 + 1)), prepend=-1))


def signature(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of PLACES uint16 for each text with shingles; counts are all positive."""
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    out = np.empty((len(counts), PLACES), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(PLACES):
            least = np.minimum.reduceat((found ^ _XOR[k]) * _ODD[k], starts)
            out[:, k] = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return out


def keys_of(sig: np.ndarray, radius: int) -> np.ndarray:
    """PLACES keys for each signature: a chunk without one of its symbols."""
    chunks = radius // 2 + 1
    chunk = np.sort(np.arange(PLACES) % chunks)
    with np.errstate(over="ignore"):
        own = (sig.astype(np.uint64) + np.uint64(1)) * _SPREAD
        sums = np.stack([own[:, chunk == c].sum(axis=1, dtype=np.uint64) for c in range(chunks)], axis=1)
        return shingles.mixed(sums[:, chunk] - own + _SALT)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = shingles.column_bytes(batch.column("text"))
        n = batch.num_rows
        size, hi, lo = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        sigs: list = [None] * n
        for i, j in shingles.slices(offsets):
            found, counts = shingles.distinct(*shingles.hashes(data, offsets[i : j + 1]))
            size[i:j] = counts
            full = np.flatnonzero(counts)
            if len(full):
                starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
                with np.errstate(over="ignore"):
                    hi[i + full] = np.add.reduceat(shingles.mixed(found + np.uint64(1)), starts).view(np.int64)
                    lo[i + full] = np.add.reduceat(shingles.mixed(found ^ np.uint64(0x5DEECE66D1234567)), starts).view(np.int64)
                for k, s in zip(full.tolist(), signature(found, counts[full])):
                    sigs[i + k] = s.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(size), pa.array(hi), pa.array(lo), pa.array(sigs, pa.binary())], ["id", "text_key", "n_shingles", "hi", "lo", "sig"])


def text_key(text: Column) -> Column:
    """A digest of 128 bits that tells texts apart."""
    return F.unhex(F.md5(text.cast("binary")))


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, n_shingles, digest (hi, lo) and signature of each row."""
    text = common.text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_key(text).alias("text_key"), text.alias("text"))
    long = [StructField(c, LongType()) for c in ("n_shingles", "hi", "lo")]
    kind = StructType([StructField("id", rows.schema["id"].dataType), StructField("text_key", BinaryType()), *long]).add("sig", "binary")
    return rows.mapInArrow(common.tidied(_sign), kind)


def _keys(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys = keys_of(_signatures(part.column("sig")), radius)
                place = np.tile(np.arange(PLACES, dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(place), pa.array(np.repeat(part.column("node").to_numpy(), PLACES))], ["key", "place", "node"])

    return run


def _signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, PLACES)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for k in range(PLACES):
        out += a[:, k, None] != b[None, :, k]
    return out


def _sizes_allow(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _partners(node, sig, size, percent):
    """(a, b, distance) for members of one key: a partner for each member that has one."""
    free, tried = np.ones(len(node), bool), np.zeros(len(node), bool)
    for _ in range(16):  # groups of near copies end here, after few leaders
        left = np.flatnonzero(free)
        fresh = left[~tried[left]]
        if len(left) < 2 or not len(fresh):
            break
        d = _apart(sig[fresh[:1]], sig[left])[0]
        near = (d <= radius_of(percent)) & _sizes_allow(size[fresh[0]], size[left], percent) & (left != fresh[0])
        tried[fresh[0]] = True
        if near.any():
            yield node[left[near]], np.full(near.sum(), node[fresh[0]]), d[near]
            free[left[near]] = False
            free[fresh[0]] = False
    left = np.flatnonzero(free)
    for i in range(0, len(left), 256):
        own = left[i : i + 256]
        d = _apart(sig[own], sig).astype(np.int64)
        d[~_sizes_allow(size[own, None], size[None, :], percent)] = 255
        d[np.arange(len(own)), own] = 255
        best = d.argmin(axis=1)
        least = d[np.arange(len(own)), best]
        if (ok := least <= radius_of(percent)).any():
            yield node[own[ok]], node[best[ok]], least[ok]


def _by_group(work, held_bytes: int = 1 << 24):
    """A function of batches that calls work with tables of whole (key, part) groups and
    their bounds; rows come sorted, and a group may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(table: pa.Table, last: bool):
            group = np.stack([table.column(c).to_numpy() for c in ("key", "part")], axis=1)
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            stop = table.num_rows if last else (int(cuts[-1]) if len(cuts) else 0)
            held[:] = table.slice(stop).to_batches()
            if stop:
                yield from work(table.slice(0, stop), np.concatenate(([0], cuts[cuts < stop], [stop])))

        for batch in batches:
            held.append(batch)
            if sum(x.nbytes for x in held) >= held_bytes:
                yield from whole(pa.Table.from_batches(held), False)
        if held:
            yield from whole(pa.Table.from_batches(held), True)

    return run


def _nearest(percent: int):
    """(a, b, distance): for each group's members the nearest partner found."""

    def work(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, size, sig = table.column("node").to_numpy(), table.column("n_shingles").to_numpy(), _signatures(table.column("sig"))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a > 1 and (found := list(_partners(node[a:b], sig[a:b], size[a:b], percent))):
                cols = [np.concatenate([x[k] for x in found]).astype(np.int64) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "distance"])

    return _by_group(work)


def _pairs(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows x < y of each group, about PAIRS at once."""
    n = int(bounds[-1])
    ends = np.repeat(bounds[1:], np.diff(bounds))
    count = ends - np.arange(n) - 1
    upto = np.concatenate(([0], np.cumsum(count)))
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
        x = np.repeat(np.arange(at, stop), count[at:stop])
        yield x, x + 1 + np.arange(len(x)) - (upto[x] - upto[at])
        at = stop


def _owned(percent: int):
    """The members (key, part, node, comp, n_shingles) of pairs across components that lie
    within the radius and share no lower key."""
    radius = radius_of(percent)
    starts = chunk_starts(radius)

    def work(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        size, comp, place = (table.column(c).to_numpy() for c in ("n_shingles", "comp", "place"))
        sig, wanted = _signatures(table.column("sig")), np.zeros(table.num_rows, bool)
        for x, y in _pairs(bounds):
            ok = (comp[x] != comp[y]) & _sizes_allow(size[x], size[y], percent) & ~(wanted[x] & wanted[y])
            x, y = x[ok], y[ok]
            other = sig[x] != sig[y]
            ok = other.sum(axis=1) <= radius
            x, y, other = x[ok], y[ok], other[ok]
            if not len(x):
                continue
            apart = np.add.reduceat(other, starts, axis=1, dtype=np.uint8)
            chunk = (apart <= 1).argmax(axis=1)  # the first chunk that gives a shared key
            begin = starts[chunk]
            within = np.where(np.arange(PLACES) >= begin[:, None], other, False).argmax(axis=1)
            ok = place[x] == np.where(apart[np.arange(len(x)), chunk] == 0, begin, within)
            wanted[x[ok]] = wanted[y[ok]] = True
        if wanted.any():
            yield from table.select(["key", "part", "node", "comp", "n_shingles"]).filter(pa.array(wanted)).combine_chunks().to_batches(10_000)

    return _by_group(work)


def _joins(percent: int):
    """(a, b): links between members of a group, on full sets, that join components."""

    def work(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
        own = table.column("own").combine_chunks()
        own = own if isinstance(own, pa.Array) else pa.concat_arrays(own.chunks)
        a, b = [], []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            for x, y in linked([np.frombuffer(own[k].as_buffer(), np.uint64) for k in range(i, j)], comp[i:j], percent):
                a.append(node[i + x])
                b.append(node[i + y])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], ["a", "b"])

    return _by_group(work, 1 << 25)


def linked(sets: list[np.ndarray], comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (x, y) of similar sets that join components, fewer than there are sets.

    Each set marks its hashes once and is counted against all others at once that it may
    still be joined with."""
    _, part = np.unique(comp, return_inverse=True)
    size = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(size)))
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    mark, out = np.zeros(len(values), bool), []
    for x in range(len(sets) - 1):
        rest = np.arange(x + 1, len(sets))
        rest = rest[(part[rest] != part[x]) & _sizes_allow(size[x], size[rest], percent)]
        if not len(rest):
            continue
        own = code[starts[x] : starts[x + 1]]
        mark[own] = True
        if len(rest) * 2 > len(sets) - x:
            both = np.add.reduceat(mark[code[starts[x + 1] :]], starts[x + 1 : -1] - starts[x + 1], dtype=np.int64)[rest - x - 1]
        else:
            both = np.array([np.count_nonzero(mark[code[starts[y] : starts[y + 1]]]) for y in rest])
        mark[own] = False
        for y in rest[100 * both >= percent * (size[x] + size[rest] - both)].tolist():
            if part[y] != part[x]:
                out.append((x, y))
                part[part == part[y]] = part[x]
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = shingles.column_bytes(batch.column("text"))
        for i, j in shingles.slices(offsets):
            found, counts = shingles.distinct(*shingles.hashes(data, offsets[i : j + 1]))
            at = np.concatenate(([0], np.cumsum(counts)))
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), pa.array([found[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary())], ["node", "own"])


def _confirm(percent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("own_a"), batch.column("own_b")
            ok = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                common_n = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common_n >= percent * (len(x) + len(y) - common_n))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b")
    return both.mapInArrow(common.tidied(_confirm(percent)), "a long, b long")


def _labelled(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """nodes with comp, the root of their component or themselves."""
    if roots is None:
        return nodes.withColumn("comp", F.col("node"))
    return nodes.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def _blocks(rows: DataFrame) -> DataFrame:
    """rows (key, comp, node, n_shingles, ...) with part, the groups that they are compared
    in. Of the component with most members in a key (the major one) no two are compared, so
    its blocks meet the blocks of all other members, and these meet each other. A key that
    fits one block is one group."""
    weight = F.sum(1 + F.col("n_shingles") / SHINGLES)
    of_comp = rows.groupBy("key", "comp").agg(weight.alias("weight"))
    most = F.max(F.struct("weight", "comp"))
    keys = of_comp.groupBy("key").agg(most.alias("most"), F.sum("weight").alias("all")).where("all > most.weight")
    blocks = lambda x: F.greatest(F.ceil(x / BLOCK), F.lit(1)).cast("long")
    fits = F.col("all") <= BLOCK
    keys = keys.select("key", F.col("most.comp").alias("major"), F.when(fits, 1).otherwise(blocks(F.col("most.weight"))).alias("nb"), F.when(fits, 1).otherwise(blocks(F.col("all") - F.col("most.weight"))).alias("mb"))
    count = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    mine = lambda n: F.pmod(F.xxhash64("node"), n)
    nb, mb, major = F.col("nb"), F.col("mb"), F.col("comp") == F.col("major")
    with_minor = F.transform(count(mb), lambda j: mine(nb) * mb + j)
    with_major = F.transform(count(nb), lambda i: i * mb + mine(mb))
    others = F.transform(F.filter(count(mb), lambda j: j != mine(mb)), lambda j: (nb + F.least(j, mine(mb))) * mb + F.greatest(j, mine(mb)))
    part = F.when(major, with_minor).otherwise(F.concat(with_major, others))
    return rows.join(keys, "key").withColumn("part", F.explode(part)).drop("major", "nb", "mb")


def _maybe_in(rows: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """rows without most of those whose value of the column `on` is not in wanted; all whose
    value is in wanted stay. wanted is folded to BITMAPS bitmaps, whose size doesn't grow."""
    spot = F.xxhash64(on)
    at, bit = F.pmod(F.shiftright(spot, 20), F.lit(BITMAPS)), F.pmod(spot, F.lit(BITS)).cast("int")
    maps = wanted.select(at.alias("_at"), bit.cast("long").alias("_bit")).groupBy("_at").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    dealt = rows.withColumn("_at", at).withColumn("_bit", bit)
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = dealt.join(F.broadcast(maps), "_at").withColumn("_byte", byte)
    return held.where("shiftright(_byte, _bit % 8) % 2 = 1").select(*rows.columns)


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): a row (id, text_key, n_shingles, hi, lo) for each document, and for
    each set of shingles a class (hi, lo, node, comp) with its component."""
    signed = common.written(sign(docs, id_col, text_col), "near-signed")
    rows = signed.drop("sig")
    once = signed.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min(F.struct("text_key", F.xxhash64("id").alias("pick"))).alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = common.written(once.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    keys = classes.select("node", "sig").mapInArrow(common.tidied(_keys(radius_of(percent))), "key long, place int, node long")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = common.written(keys.join(shared, "key"), "near-members")
    info = classes.select("node", "n_shingles", "sig")

    def sets_of(nodes: DataFrame, name: str) -> DataFrame:
        """The full sets of nodes, from the text of one document of each class."""
        text = common.text_of(text_col)
        texts = docs.select(F.struct(text_key(text).alias("text_key"), F.xxhash64(id_col).alias("pick")).alias("doc"), text.alias("text"))
        wanted = common.written(nodes.join(classes.select("node", "doc"), "node"), f"{name}-wanted")
        one = _maybe_in(texts, wanted, "doc").join(wanted, "doc").dropDuplicates(["node"])
        return common.written(one.select("node", "text").mapInArrow(common.tidied(_sets), "node long, own binary"), name)

    # keys of many members: nearest partners, block by block
    links = roots = None
    many = members.where(F.col("members") > MANY).select("key", "node")
    while True:
        one = many.withColumn("comp", F.col("node"))
        if roots is not None:
            one = many.join(_labelled(classes.select("node"), roots), "node").groupBy("key", "comp").agg(F.min("node").alias("node"))
        fits = one.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        fits = common.written(fits, "near-many")
        most = fits.agg(F.max("n")).first()[0]
        if most is None:
            break
        part = F.pmod(F.xxhash64("node", F.lit(0 if links is None else 1)), F.ceil(F.col("n") / BLOCK).cast("long"))
        dealt = one.drop("comp").join(fits, "key").join(info, "node").withColumn("part", part).drop("n")
        found = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(common.tidied(_nearest(percent)), "a long, b long, distance long")
        best = common.written(found.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("x")).select("a", F.col("x.b").alias("b")), "near-best")
        sets = sets_of(best.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-sets")
        more = common.written(_confirmed(best, sets, percent), "near-links")
        common.forget(sets)
        if more.isEmpty():
            break
        links = more if links is None else common.written(links.unionByName(more), "near-links")
        roots = components(links)
        if most <= BLOCK:
            break
        many = many.join(fits.where(F.col("n") > BLOCK).select("key"), "key", "left_semi")

    # all keys: full sets meet at the owners of pairs
    rest = _blocks(members.select("key", "place", "node").join(_labelled(classes.select("node", "n_shingles"), roots), "node"))
    dealt = rest.join(info.select("node", "sig"), "node").repartition("key", "part").sortWithinPartitions("key", "part", "node")
    owned = common.written(dealt.mapInArrow(common.tidied(_owned(percent)), "key long, part long, node long, comp long, n_shingles long"), "near-owned")
    sets = sets_of(owned.select("node").distinct(), "near-sets")
    held = owned.drop("n_shingles").join(sets, "node").repartition("key", "part").sortWithinPartitions("key", "part", "node")
    more = common.written(held.mapInArrow(common.tidied(_joins(percent)), "a long, b long"), "near-links")
    common.forget(sets, owned, members)
    if not more.isEmpty():
        links = more if links is None else links.unionByName(more)
        roots = components(links)
    return rows, _labelled(classes.select("hi", "lo", "node"), roots)


def find_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """A row for each row of docs: id_col, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of shingles.
    component_id is the smallest id that can be reached over links; kept marks rows with
    that id. Texts without words (null, empty, blank) have no shingles, are linked with
    nothing and are kept. A null id is never a component_id unless no id can be reached.
    Rows with equal ids are documents of their own. An empty table gives no rows."""
    rows, classes = classes_of(docs, id_col, text_col, percent)
    named = rows.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min("id").alias("least")).join(classes, ["hi", "lo"])
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = common.written(named.select("hi", "lo", "comp").join(least, "comp").select("hi", "lo", "component_id"), "near-named")
    out = rows.join(known, ["hi", "lo"], "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """docs with one row of each component, all columns kept, and all rows without words.

    The row with the smallest id stays (without id last, then by the hash of its text);
    repeats of that row are folded into one."""
    rows, classes = classes_of(docs, id_col, text_col, percent)
    named = rows.where("n_shingles > 0").join(classes, ["hi", "lo"])
    keep = named.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")).alias("best"))
    key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keep = common.written(keep.select(key(F.col("best.id")).alias("key"), F.col("best.no_id").alias("no_id"), F.col("best.text_key").alias("text_key")), "near-keep")
    text = common.text_of(text_col)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key(F.col(id_col)).alias("key"), F.col(id_col).isNull().alias("no_id"), text_key(text).alias("text_key"), text.rlike(common.WORD).alias("worded"))
    on = ["key", "no_id", "text_key"]
    chosen = packed.where("worded").join(keep, on, "left_semi").dropDuplicates(on)
    return chosen.select("row.*").unionByName(packed.where("not worded").select("row.*"))
