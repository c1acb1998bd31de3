"""A prefix trie of conversations, built family by family and merged by node.

Conversations whose ids share a base form a family; each is rebuilt from the first turns of
its base and its own later ones. A turn is its digest and size from the start, so the tasks
that build tries hold fixed-size rows, never texts. A node's key is a digest chained from the
root, so equal prefixes have equal keys in all families, and what is shuffled for the global
trie is one row for each node of each family.

Sums over subtrees need no walk over the global trie. For a node u, the bytes of all members'
turns from u on are sums over its members, so over family nodes. What counts each node of a
subtree once (its bytes, whether it is a leaf) is counted in the family of the node's smallest
member, to which merged nodes go back; a member of a node is a member of all above it, so the
family's own trie has them all.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, heavy

FAMILY, MOST_SHARED = 5, 8
ROOT = hashlib.sha256(b"").digest()
#: Ends of a node are put together by ranges of ids, so each part has that many ids at most.
ENDS_RANGE = 10_240


def shared_turns(conv_id: int) -> int:
    """How many of its base's first turns a conversation takes, 0 to MOST_SHARED."""
    return zlib.crc32(str(conv_id).encode()) % (MOST_SHARED + 1)


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def digested(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(base, conv_id, place, item, size): each turn's place from 0, digest of role and text,
    and bytes of its text."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    item = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return rows.select(base_of(F.col("conv_id")).alias("base"), "conv_id", (F.row_number().over(order) - 1).alias("place"), item.alias("item"), F.octet_length("text").cast("long").alias("size"))


FAMILY_NODES = "base long, key binary, parent binary, depth long, size long, conv_id long, n_convs long, mass long, inner long, ends array<long>"
_FAMILY_ARROW = pa.schema([("base", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), *[(c, pa.int64()) for c in ("depth", "size", "conv_id", "n_convs", "mass", "inner")], ("ends", pa.list_(pa.int64()))])


def _family(key: tuple[pa.Scalar, ...], own: pa.Table, shared: pa.Table) -> pa.Table:
    """The trie of a family: a row for each node, merged over its conversations."""
    head = [(x["item"], x["size"]) for x in shared.sort_by("place").to_pylist()]
    convs: dict[int, list[tuple[bytes, int]]] = {}
    for conv, item, size in zip(*(own.sort_by([("conv_id", "ascending"), ("place", "ascending")]).column(c).to_pylist() for c in ("conv_id", "item", "size"))):
        convs.setdefault(conv, []).append((item, size))
    nodes: dict[bytes, list] = {}
    for conv, turns in convs.items():  # ascending, so the first that comes to a node is its smallest
        h = shared_turns(conv)
        rebuilt = head[:h] + turns[h:]
        mass = sum(size for _, size in rebuilt)
        at, parent = ROOT, None
        for depth in range(len(rebuilt) + 1):
            item, size = rebuilt[depth - 1] if depth else (b"", 0)
            if depth:
                parent, at = at, hashlib.sha256(at + item).digest()
                nodes[parent][6] = 1
            node = nodes.setdefault(at, [parent, depth, size, conv, 0, 0, 0, []])
            node[4] += 1
            node[5] += mass
            mass -= size
        nodes[at][7].append(conv)
    columns = list(zip(*nodes.values())) or [[]] * 8
    return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(nodes), pa.int64()), pa.array(list(nodes), pa.binary()), *[pa.array(c, f.type) for c, f in zip(columns, list(_FAMILY_ARROW)[2:])]], schema=_FAMILY_ARROW)


OWNED_SUMS = "key binary, once long, n_leaves long, n_children long"
_OWNED_ARROW = pa.schema([("key", pa.binary()), *[(c, pa.int64()) for c in ("once", "n_leaves", "n_children")]])


def _owned(family: pa.Table, owned: pa.Table) -> pa.Table:
    """For each node of a family, sums over those nodes of its subtree that the family owns:
    their bytes, the leaves among them, and the node's own children among them."""
    leaf = dict(zip(owned.column("key").to_pylist(), owned.column("leaf").to_pylist()))
    rows = family.sort_by([("depth", "descending")])
    sums: dict[bytes, list[int]] = {k: [0, 0, 0] for k in rows.column("key").to_pylist()}
    for key, parent, size in zip(*(rows.column(c).to_pylist() for c in ("key", "parent", "size"))):
        if key in leaf:
            sums[key][0] += size
            sums[key][1] += leaf[key]
        if parent is not None:
            up = sums[parent]
            up[0] += sums[key][0]
            up[1] += sums[key][1]
            up[2] += key in leaf
    some = {k: v for k, v in sums.items() if any(v)}
    return pa.Table.from_arrays([pa.array(list(some), pa.binary()), *[pa.array([v[i] for v in some.values()], pa.int64()) for i in range(3)]], schema=_OWNED_ARROW)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of ids that come in order, node by node, part by part."""
    last, digest = None, None
    done: list[tuple[bytes, str]] = []
    for batch in batches:
        for key, part in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist()):
            if key == last:
                digest.update(b"," + part.encode())
                continue
            if last is not None:
                done.append((last, digest.hexdigest()))
            last, digest = key, hashlib.sha256(part.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], ["key", "ends_sha256"])
            done = []
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])


def ends_of(families: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end. The digest is sequential, so
    a node's ids go through one task in order; they are put together by ranges of ids before
    and stream by, so that task holds one part of ENDS_RANGE ids at most."""
    ends = families.where(F.size("ends") > 0).select("key", F.explode("ends").alias("conv_id"))
    parts = ends.groupBy("key", F.floor(F.col("conv_id") / ENDS_RANGE).alias("range")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    joined = parts.select("key", "range", F.array_join(F.col("ids").cast("array<string>"), ",").alias("part"))
    return joined.repartition("key").sortWithinPartitions("key", "range").select("key", "part").mapInArrow(common.tidied(_ends), "key binary, ends_sha256 string")


def trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each node of the trie of all rebuilt conversations: conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, ties by role and text; a null role or text is
    empty; repeated rows are turns each. Rows without a conversation's id belong to none and
    are left out; ids must be whole numbers. An empty table gives no rows, not even a root. A
    family's turns, as fixed-size digests, are held by one task; other columns are ignored."""
    if turns.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {turns.schema[id_col].dataType.simpleString()}, not a whole number")
    own = common.written(digested(turns, id_col, turn_col, role_col, text_col), "trie-turns")
    heads = own.where((F.col("conv_id") == F.col("base")) & (F.col("place") < MOST_SHARED)).select("base", "place", "item", "size")
    families = common.written(own.groupBy("base").cogroup(heads.groupBy("base")).applyInArrow(_family, FAMILY_NODES), "trie-families")

    merged = families.groupBy("key", "parent", "depth", "size").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("mass").alias("mass"), F.max("inner").alias("inner"))
    merged = common.written(merged, "trie-nodes")
    owned = merged.select(base_of(F.col("conv_id")).alias("base"), "key", (1 - F.col("inner")).alias("leaf"))
    parts = families.select("base", "key", "parent", "depth", "size").groupBy("base").cogroup(owned.groupBy("base")).applyInArrow(_owned, OWNED_SUMS)
    sums = parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("once", "n_leaves", "n_children")])
    nodes = merged.join(sums, "key", "left").join(ends_of(families), "key", "left").na.fill(0, ["once", "n_leaves", "n_children"])
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    nodes = nodes.select("key", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", (F.col("mass") - F.col("once")).alias("saved_tokens"), ends.alias("ends_sha256"))
    nodes = common.written(nodes, "trie-sums")

    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = heavy.joined(nodes.where("parent is not null"), parents.where("n_children > 0").withColumnRenamed("n_children", "children"), "parent", "children")
    top = nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below.unionByName(top).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
