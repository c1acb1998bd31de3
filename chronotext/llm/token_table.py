"""Token ids in sorted-string-table shards, in files of the shared folder.

A shard holds documents of a range of ids in ascending order:

    block*   zstd of entries; an entry is (bytes of the key shared with the one before, rest
             of the key, length of the value, value), so keys are prefix-compressed
    index    for each block its first key, place, length, documents and tokens before it
    bloom    a Bloom filter of the keys
    footer   fixed length: places of index and bloom, documents, tokens, width, magic

A key is the id as 8 bytes that sort like it, after a byte that sorts null last. A value is
the ids in 2 bytes each, or 4 if the vocabulary needs them. ``find`` looks a key up by Bloom
filter, binary search in the index and a scan of one block.

A task writes its shard under a name of its own and renames it when it is complete, so that
a repeated task replaces the file by the same. Paths go through pyarrow's file systems.
"""

from __future__ import annotations

import bisect
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import byte_bpe, common, shingles

MAGIC = b"CTOKTAB1"
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK = 1 << 18
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: A manifest of at most so many shards is broadcast for lookups.
MOST_SHARDS = 100_000


def key_of(doc_id: int | None) -> bytes:
    return b"\x01" if doc_id is None else b"\x00" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\x01" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard to an open stream; keys come in ascending order."""

    def __init__(self, stream, width: int, size: int = BLOCK):
        self.stream, self.width, self.kind, self.size = stream, width, {2: "<u2", 4: "<u4"}[width], size
        self.at = self.docs = self.tokens = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self._open_block()

    def _open_block(self) -> None:
        self.block, self.held, self.before, self.first, self.block_docs, self.block_tokens = [], 0, b"", b"", self.docs, self.tokens

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.block:
            self.first = key
        n = 0
        while n < min(len(key), len(self.before)) and key[n] == self.before[n]:
            n += 1
        value = ids.astype(self.kind).tobytes()
        head = _varint(n) + _varint(len(key) - n) + key[n:] + _varint(len(value))
        self.block += (head, value)
        self.held += len(head) + len(value)
        self.before = key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.docs += 1
        self.tokens += len(ids)
        if self.held >= self.size:
            self._close_block()

    def _close_block(self) -> None:
        raw = b"".join(self.block)
        packed = pa.compress(raw, codec="zstd", asbytes=True)
        self.stream.write(packed)
        self.index.append(_varint(len(self.first)) + self.first + struct.pack("<QIIQQ", self.at, len(packed), len(raw), self.block_docs, self.block_tokens))
        self.at += len(packed)
        self._open_block()

    def close(self) -> None:
        if self.block:
            self._close_block()
        index = b"".join(self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.stream.write(index + bytes(bloom))
        self.stream.write(FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.docs, self.tokens, self.width, len(self.index), MAGIC))


class Reader:
    """Reads a shard through pyarrow's random access files."""

    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        index_at, index_len, bloom_at, self.bits, self.docs, self.tokens, self.width, blocks, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token table")
        raw, at = self.file.read_at(index_len, index_at), 0
        self.bloom = self.file.read_at((self.bits + 7) // 8, bloom_at)
        self.first, self.blocks = [], []
        for _ in range(blocks):
            n, at = _read_varint(raw, at)
            self.first.append(raw[at : at + n])
            self.blocks.append(struct.unpack_from("<QIIQQ", raw, at + n))
            at += n + 32

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def block(self, i: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, tokens of the shard before, ids) of each document of block i."""
        at, packed, size, _, start = self.blocks[i]
        raw = pa.decompress(self.file.read_at(packed, at), size, codec="zstd", asbytes=True)
        key, p = b"", 0
        while p < len(raw):
            n, p = _read_varint(raw, p)
            m, p = _read_varint(raw, p)
            key = key[:n] + raw[p : p + m]
            n, p = _read_varint(raw, p + m)
            ids = np.frombuffer(raw, {2: "<u2", 4: "<u4"}[self.width], n // self.width, p)
            p += n
            yield key, start, ids
            start += len(ids)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits))

    def find(self, key: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """(tokens before, ids) of each document with that key."""
        if not self.may_have(key):
            return
        i = max(0, bisect.bisect_left(self.first, key) - 1)
        while i < len(self.first) and self.first[i] <= key:
            for k, start, ids in self.block(i):
                if k == key:
                    yield start, ids
            i += 1


MANIFEST = "path string, docs long, tokens long, low binary, high binary"


def _write(tokenizer: str, end_id: int | None, folder: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                encoder = byte_bpe.encoder(tokenizer)
                width = 2 if max(encoder.size, end_id or 0) <= 1 << 16 else 4
                context = TaskContext.get()
                path = f"{folder}/shard-{context.partitionId():06d}.sst"
                fs, at = pafs.FileSystem.from_uri(path)
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                own = f"{at}.{context.taskAttemptId()}.tmp"
                stream = fs.open_output_stream(own)
                out = Writer(stream, width, block)
                low = key_of(batch.column("id")[0].as_py())
            _, offsets = shingles.column_bytes(batch.column("text"))
            for i, j in shingles.slices(offsets):
                keys = [key_of(x) for x in batch.column("id").slice(i, j - i).to_pylist()]
                for key, ids in zip(keys, encoder.encode(batch.column("text").slice(i, j - i))):
                    out.add(key, np.concatenate((ids, tail)))
                high = keys[-1]
        if out is not None:
            out.close()
            stream.close()
            fs.move(own, at)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([out.docs]), pa.array([out.tokens]), pa.array([low], pa.binary()), pa.array([high], pa.binary())], ["path", "docs", "tokens", "low", "high"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None, folder: str | None = None, block: int = BLOCK) -> DataFrame:
    """Encodes docs, appends end_id to each, writes the shards and returns their manifest:
    path, docs, tokens, low and high key, and start, the tokens of all shards before.

    Shards follow each other by ascending id, null last, rows of equal ids by a hash of
    their text. Ids are whole numbers (byte to bigint; others are refused). Null texts are
    empty. An empty table gives no shards."""
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}; keys of the table are whole numbers")
    folder = folder or f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text"))
    dealt = rows.repartitionByRange(F.col("id").asc_nulls_last()).sortWithinPartitions(F.col("id").asc_nulls_last(), F.xxhash64("text"))
    shards = common.written(dealt.mapInArrow(_write(tokenizer, end_id, folder, block), MANIFEST), "token-manifest")
    before = Window.orderBy("low", "high", "path").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            with Reader(path) as shard:
                for i in range(len(shard.blocks)):
                    got = list(shard.block(i))
                    yield pa.RecordBatch.from_arrays([pa.array([id_of(k) for k, _, _ in got], pa.int64()), pa.array([base + s for _, s, _ in got], pa.int64()), pa.array([len(x) for _, _, x in got], pa.int64()), pa.array([x.astype("<u4").tobytes() for _, _, x in got], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids as little-endian unsigned 32-bit) of all documents, read
    from the shards, dealt to as many tasks as there are shards: the manifest is small, and
    adaptive execution would else bring all of it to one task."""
    shards = manifest.select("path", "start")
    return shards.repartition(max(1, manifest.count()), "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, at = None, None
    for batch in batches:
        out = []
        for path, base, wanted in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "wanted"))):
            if path != at:
                shard, at = Reader(path), path
            out += [(wanted, base + start, len(ids), ids.astype("<u4").tobytes()) for start, ids in shard.find(key_of(wanted))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "n_tokens", "ids"])


def find_tokens(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """As read_tokens, for the distinct ids of wanted only, by lookup in the shards whose
    range of keys holds them.

    The manifest is broadcast up to MOST_SHARDS rows (100 bytes each); beyond that Spark picks
    the join. A null id finds the rows without id; an id that is not there gives no row."""
    flip = F.expr("unhex(lpad(hex(wanted ^ cast('-9223372036854775808' as bigint)), 16, '0'))")
    ids = wanted.select(F.col(id_col).cast("long").alias("wanted")).distinct()
    ids = ids.withColumn("key", F.when(F.col("wanted").isNull(), F.unhex(F.lit("01"))).otherwise(F.concat(F.unhex(F.lit("00")), flip)))
    routed = ids.join(F.broadcast(manifest) if manifest.count() <= MOST_SHARDS else manifest, F.col("key").between(F.col("low"), F.col("high")))
    return routed.select("path", "start", "wanted").repartition("path").sortWithinPartitions("path", "wanted").mapInArrow(_find, "doc_id long, start long, n_tokens long, ids binary")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

