"""SentencePiece encoding and decoding by a Unigram model.

Pieces and their log scores come from a model file; a double-array trie of the pieces' bytes
is built from them once, on the driver, and shipped to the tasks (its size is that of the
vocabulary). Encoding takes the path of the greatest sum of scores (Viterbi). A character
that is no piece gets a score below all others and is written as byte pieces. White space
is written as a marker, and a marker is put before the text; decoding undoes both.
A piece that scores below other pieces which together spell it is on no best path, whatever
stands around it, so the trie is built without such pieces.

In the files at hand no piece has a marker after another character, so a text's best path
consists of those of its words with the markers before them. Words are encoded once for as
long as a process remembers them, many at a time: first all places of all words walk the trie
together, then the words' best paths grow byte by byte, a column for each word.
A long word goes byte by byte, and what all its open paths share is settled as it goes, so its
back pointers span a stretch and not the word.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common, shingles
from .word_cache import WordCache

MARK = "▁"
#: Kinds of pieces in model files, and how far below the least score an unknown character is.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
PENALTY = 10.0
#: How far, relative to its score, a piece must be below others to be left out: beyond rounding.
MARGIN = 1e-6
#: Bytes of words that are encoded at once, and what stands after a word's end: no byte.
CELLS, NO_BYTE = 1 << 16, 256
#: Places of a double array that are tried at once.
CHUNK = 1024
#: Bytes of words and ids that a process remembers before it starts anew, about; longer words
#: are not remembered, and are encoded in stretches of so many bytes.
REMEMBERED, LONG_WORD, STRETCH = 32 << 20, 256, 1 << 14
#: Words of a text that are looked up at once.
AT_ONCE = 1 << 17


def _varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a message's fields: integers, or bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            n, at = (8, at) if tag & 7 == 1 else (4, at) if tag & 7 == 5 else _varint(data, at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) in the order of ids, from a model file."""
    with open(path, "rb") as f:
        data = f.read()
    pieces = []
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
    return pieces


@dataclass
class Trie:
    """Double array: from state s byte c leads to t = base[s] + c if check[t] == s; piece[t]
    is the id of the piece that ends there, or -1. State 0 is the root."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray


def build_trie(words: dict[bytes, int]) -> Trie:
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for word in sorted(words):
        s = 0
        for c in word:
            t = children[s].get(c)
            if t is None:
                t = children[s][c] = len(children)
                children.append({})
                ends.append(-1)
            s = t
        ends[s] = words[word]
    size = 2 * len(children) + 1024
    base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = np.zeros(size, bool)
    taken[0] = True
    state = {0: 0}
    free, todo = 1, [0]
    while todo:  # nodes with many children find room while the array is empty
        todo.sort(key=lambda n: -len(children[n]))
        later = []
        for node in todo:
            own = np.array(sorted(children[node]))
            if not len(own):
                continue
            while taken[free]:
                free += 1
            b = max(1, free - int(own[0]))
            while True:  # CHUNK places at a time
                if b + CHUNK + 256 >= len(taken):
                    grow = len(taken) + CHUNK
                    base, taken = np.concatenate((base, np.zeros(grow, np.int32))), np.concatenate((taken, np.zeros(grow, bool)))
                    check, piece = (np.concatenate((x, np.full(grow, -1, np.int32))) for x in (check, piece))
                if len(own) == 1 and not taken[b + own[0]]:
                    break
                clash = taken[b + own[0] : b + own[0] + CHUNK].copy()
                for c in own[1:].tolist():
                    clash |= taken[b + c : b + c + CHUNK]
                first = int(clash.argmin())
                if not clash[first]:
                    b += first
                    break
                b += CHUNK
            s = state[node]
            base[s] = b
            for c in own.tolist():
                child = children[node][c]
                state[child] = b + c
                check[b + c], piece[b + c] = s, ends[child]
                later.append(child)
            taken[b + own] = True
        todo = later
    room = int(np.flatnonzero(taken)[-1]) + 257  # so that no step leaves the arrays
    pad = max(0, room - len(base))
    return Trie(np.pad(base, (0, pad))[:room], np.pad(check, (0, pad), constant_values=-1)[:room], np.pad(piece, (0, pad), constant_values=-1)[:room])


def useful(pieces: dict[bytes, float]) -> dict[bytes, float]:
    """The pieces that can be on a best path: those that no other pieces spell with a greater sum."""
    kept, lengths = {}, sorted({len(p) for p in pieces})
    for word, score in pieces.items():
        n, best = len(word), {0: 0.0}
        for p in range(n):
            own = best.get(p)
            if own is None:
                continue
            for d in lengths:
                if p + d > n or d == n:
                    break
                add = pieces.get(word[p : p + d])
                if add is not None and own + add > best.get(p + d, float("-inf")):
                    best[p + d] = own + add
        if best.get(n, float("-inf")) <= score + MARGIN * max(1.0, abs(score)):
            kept[word] = score
    return kept


class Model:
    """What encoding and decoding need; made on the driver, small, and shipped to tasks."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        normal = [s for _, s, kind in pieces if kind == NORMAL]
        self.scores = np.array([s for _, s, _ in pieces], np.float64)
        self.unknown_score = min(normal, default=0.0) - PENALTY
        number = {p.encode(): i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        self.trie = build_trie({p: number[p] for p in useful({p: float(self.scores[i]) for p, i in number.items()})})
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_ids = np.array([self.bytes.get(c, self.unknown) for c in range(256)], np.uint32)
        self.splits = not any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind in (NORMAL, USER))
        written = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.encode() for p, _, kind in pieces]
        self.text = np.frombuffer(b"".join(written), np.uint8)
        self.text_starts = np.concatenate(([0], np.cumsum([len(x) for x in written])))

    def viterbi(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word's best path; of equal paths the one with longer first pieces
        at the last place where they differ."""
        flat, counts = self.paths(words)
        ids, stops = flat.tolist(), np.cumsum(counts).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def paths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all words' best paths one after another, counts[i] of them each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(words) + bytes(LONG_WORD), np.uint8)
        order = np.argsort(sizes, kind="stable")
        order = order[: np.searchsorted(sizes[order], LONG_WORD, "right")]
        who, found, counts, at = [], [], np.zeros(len(words), np.int64), 0
        while at < len(order):
            most = sizes[order[at : at + CELLS]] * np.arange(1, min(CELLS, len(order) - at) + 1)
            stop = at + max(1, int(np.searchsorted(most, CELLS, "right")))
            own = order[at:stop]
            ids, counts[own] = self._together(data, starts[own], sizes[own])
            who.append(own)
            found.append(ids)
            at = stop
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            own = np.array(self._long(words[i]), np.uint32)
            who.append(np.array([i]))
            found.append(own)
            counts[i] = len(own)
        if not who:
            return np.zeros(0, np.uint32), counts
        who, ends = np.concatenate(who), np.cumsum(counts)
        length = counts[who]
        flat = np.empty(int(ends[-1]), np.uint32)
        flat[np.arange(len(flat)) + np.repeat(ends[who] - np.cumsum(length), length)] = np.concatenate(found)
        return flat, counts

    def _viterbi(self, words: list[bytes]) -> list[list[int]]:
        """As ``viterbi``, with all words at once."""
        sizes = np.array([len(w) for w in words])
        flat, counts = self._together(np.frombuffer(b"".join(words) + bytes(int(sizes.max())), np.uint8), np.cumsum(sizes) - sizes, sizes)
        return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]

    def _together(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``paths``, of the words of data that begin at starts."""
        n, length = len(sizes), int(sizes.max(initial=0))
        rows = np.arange(length)[:, None]
        text = np.where(rows < sizes, data[starts + rows], NO_BYTE)  # a column for each word
        gains, kept = self._matches(text)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        came = np.zeros((length + 1, n), np.int64)
        depths = sorted(gains, reverse=True)  # of equal sums the longest last piece stays
        for end in range(1, length + 1):
            to, by = best[end], came[end]
            for d in depths:
                if d <= end and gains[d][1][end - d]:
                    total = best[end - d] + gains[d][0][end - d]
                    better = total > to
                    np.copyto(to, total, where=better)
                    np.copyto(by, d, where=better)
        # back from the ends, a step of all words at a time
        steps, cols, places = [], np.flatnonzero(sizes), sizes[sizes > 0]
        counts, flat_came = np.zeros(n, np.int64), came.ravel()
        while len(cols):
            d = flat_came[places * n + cols]
            if not d.all():
                raise ValueError("a word has no path: scores must be finite and words UTF-8")
            places = places - d
            ids = kept[d, places * n + cols]
            many = np.where(ids < 0, d, 1) if self.bytes else 1
            counts[cols] += many
            steps.append((cols, places, ids, many))
            more = places > 0
            cols, places = cols[more], places[more]
        left = np.cumsum(counts)
        flat = np.empty(int(left[-1]) if n else 0, np.uint32)
        for cols, places, ids, many in steps:
            left[cols] -= many
            at = left[cols]
            flat[at] = np.where(ids < 0, self.unknown, ids)
            odd = np.flatnonzero(ids < 0)
            for i in range(4 if len(odd) and self.bytes else 0):
                odd = odd[many[odd] > i]
                flat[at[odd] + i] = self.byte_ids[text[places[odd] + i, cols[odd]]]
        return flat, counts

    def _matches(self, text: np.ndarray) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """By length in bytes the score of the piece, or the unknown character, at each place of
        text, with the rows that have any; and the pieces' ids by length and place, -2 for unknown."""
        base, check, piece = self.trie.base, self.trie.check, self.trie.piece
        length, n = text.shape
        flat = text.ravel()
        at = np.flatnonzero((flat < 0x80) | (flat >= 0xC0) & (flat < NO_BYTE))  # where characters begin
        lead = flat[at]
        char = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        heads, width, single = at, char, np.zeros(length * n, bool)
        state, hits, depth = np.zeros(len(at), np.int64), [], 0
        while len(at):
            step = base[state] + flat[at + depth * n]
            ok = np.flatnonzero(check[step] == state)
            at, state, char = at[ok], step[ok], char[ok]
            depth += 1
            ids = piece[state]
            hit = np.flatnonzero(ids >= 0)
            if len(hit):
                hits.append((depth, at[hit], ids[hit]))
                single[at[hit[char[hit] == depth]]] = True
            ok = np.flatnonzero((base[state] > 0) & (at + depth * n < len(flat)))
            at, state, char = at[ok], state[ok], char[ok]
        lone = np.flatnonzero(~single[heads])
        hits += [(w, heads[own], -2) for w in range(1, 5) if len(own := lone[width[lone] == w])]
        gains: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        kept = np.empty((max((d for d, _, _ in hits), default=0) + 1, length * n), np.int32)
        for d, own, ids in hits:
            if d not in gains:
                gains[d] = np.full((length, n), -np.inf), np.zeros(length, bool)
            gains[d][0].ravel()[own] = self.unknown_score if isinstance(ids, int) else self.scores[ids]
            gains[d][1][own // n] = True
            kept[d, own] = ids
        return gains, kept

    def _written(self, word: bytes, start: int, stop: int, came: dict[int, int], made: dict[int, int]) -> list[int]:
        """The ids of the path from start to stop, whose back pointers go."""
        ids, p = [], stop
        while p > start:
            q, own = came.pop(p), made.pop(p)
            if own >= 0:
                ids.append(own)
            elif self.bytes:
                ids += [self.bytes[c] for c in reversed(word[q:p])]
            else:
                ids.append(self.unknown)
            p = q
        ids.reverse()
        return ids

    def _long(self, word: bytes) -> list[int]:
        """The ids of one word's best path, with the same ties as ``_viterbi``."""
        base, check, piece, scores = (memoryview(np.ascontiguousarray(x)) for x in (self.trie.base, self.trie.check, self.trie.piece, self.scores))
        ids: list[int] = []
        best, came, made = {0: 0.0}, {}, {}
        start, least, n = 0, float("-inf"), len(word)
        for p in range(n):
            own = best.pop(p, None)
            if own is None:
                continue
            lead = word[p]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            single, s, q = False, 0, p
            while q < n:
                t = base[s] + word[q]
                if check[t] != s:
                    break
                s, q = t, q + 1
                k = piece[s]
                if k >= 0:
                    single |= q - p == width
                    if own + scores[k] > best.get(q, least):
                        best[q], came[q], made[q] = own + scores[k], p, k
            if not single and own + self.unknown_score > best.get(p + width, least):
                best[p + width], came[p + width], made[p + width] = own + self.unknown_score, p, -2
            if p % STRETCH == STRETCH - 1 and p + 1 < n:
                ends = [-x for x in best]  # the last place that all open paths go through
                heapq.heapify(ends)
                open_ends = set(ends)
                while len(open_ends) > 1:
                    open_ends.discard(x := heapq.heappop(ends))
                    if (y := -came[-x]) not in open_ends:
                        open_ends.add(y)
                        heapq.heappush(ends, y)
                at = -open_ends.pop()
                if at > start:
                    kept = {x: (came[x], made[x]) for x in self._open(best, came, at)}
                    ids += self._written(word, start, at, came, made)
                    came, made, start = {x: c for x, (c, _) in kept.items()}, {x: m for x, (_, m) in kept.items()}, at
        return ids + self._written(word, start, n, came, made)

    @staticmethod
    def _open(best: dict[int, float], came: dict[int, int], at: int) -> set[int]:
        """The places after at on the paths to best."""
        found: set[int] = set()
        for x in best:
            while x > at and x not in found:
                found.add(x)
                x = came[x]
        return found

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of lists of ids that lie one after another, counts[i] of them each."""
        begin = self.text_starts[ids]
        length = self.text_starts[ids + 1] - begin
        ends = np.cumsum(length)
        data = self.text[np.arange(int(ends[-1]) if len(ids) else 0) + np.repeat(begin - (ends - length), length)].tobytes()
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        mark = MARK.encode()
        texts = []
        for a, b in zip(cuts, cuts[1:]):
            text = data[a:b].replace(mark, b" ").decode("utf-8", "replace")
            texts.append(text[1:] if text[:1] == " " else text)
        return texts


_ODD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Encoder:
    """Encodes texts; words that it has met, with a marker before them or as they stand, are
    remembered up to REMEMBERED bytes, and what one call needs besides."""

    def __init__(self, model: Model):
        self.model, self.spaced, self.odd = model, WordCache(), WordCache()

    def _bounded(self) -> None:
        if self.spaced.held + self.odd.held > REMEMBERED:
            self.spaced, self.odd = WordCache(), WordCache()

    def _learn(self, words: set[str], spaced: bool) -> WordCache:
        """The cache, which has words from now on."""
        cache, before = (self.spaced, MARK) if spaced else (self.odd, "")
        if words:
            own = list(words)
            cache.add(own, *self.model.paths([(before + w).encode("utf-8", "replace") for w in own]))
        return cache

    def _in_parts(self, pieces: list[str], spaced: bool) -> np.ndarray:
        found = []
        for i in range(0, len(pieces), AT_ONCE):
            self._bounded()
            part = pieces[i : i + AT_ONCE]
            known = (self.spaced if spaced else self.odd).number
            cache = self._learn({p for p in part if p not in known}, spaced)
            found.append(cache.ids([cache.number[p] for p in part]))
        return np.concatenate(found)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; none for an empty one."""
        if not self.model.splits:
            marked = [(MARK + t.replace(" ", MARK)).encode("utf-8", "replace") for t in texts]
            return [np.array(self.model.viterbi([m])[0] if t else [], np.uint32) for t, m in zip(texts, marked)]
        plan = []
        for text in texts:
            pieces = text.split(" ") if text else []
            spaced = "" not in pieces and MARK not in text
            pieces = pieces if spaced else _ODD.findall(MARK + text.replace(" ", MARK))
            plan.append((spaced, self._in_parts(pieces, spaced) if len(pieces) > AT_ONCE else pieces))
        self._bounded()
        for spaced in (True, False):
            known = (self.spaced if spaced else self.odd).number
            self._learn({p for own, x in plan if own == spaced and isinstance(x, list) for p in x if p not in known}, spaced)
        out = []
        for spaced, x in plan:
            cache = self.spaced if spaced else self.odd
            out.append(cache.ids([cache.number[p] for p in x]) if isinstance(x, list) else x)
        return out


_encoders: dict[str, Encoder] = {}


def _coded(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(shared.value)
        encoder = _encoders[key]
        for batch in batches:
            _, offsets = shingles.column_bytes(batch.column("text"))
            for i, j in shingles.slices(offsets):
                texts = batch.column("text").slice(i, j - i).to_pylist()
                ids = encoder.encode(texts)
                counts = np.array([len(x) for x in ids])
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                back = encoder.model.decode_all(flat, counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(flat))
                digests = [hashlib.sha256(t.encode()).hexdigest() for t in back]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), lists, pa.array(counts, pa.int64()), pa.array(digests), pa.array([a == b for a, b in zip(texts, back)])], ["id", "ids", "n_tokens", "decoded_sha256", "exact"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, n_tokens, decoded_sha256, exact) of each row of docs.

    decoded_sha256 is the digest of the text that the ids decode to, exact whether it is the
    original one; it is unless the text has the marker's own character. A null text
    counts as empty and has no ids. A long text is encoded whole, in parts of AT_ONCE words, and
    a long word in stretches. Rows are independent, so ids of documents may repeat or
    be null. An empty table gives no rows."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Model(read_pieces(path)))
    rows = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    kind = StructType([rows.schema["id"]])
    for name, t in (("ids", "array<int>"), ("n_tokens", "bigint"), ("decoded_sha256", "string"), ("exact", "boolean")):
        kind = kind.add(name, common.spark_type(t))
    return rows.mapInArrow(common.tidied(_coded(shared, path)), kind).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) of each row; null ids give a null text, ids out of range fail."""
    shared = encoded.sparkSession.sparkContext.broadcast(Model(read_pieces(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("ids").to_pylist()
            counts = np.array([len(x or ()) for x in own], np.int64)
            flat = np.array([k for x in own for k in x or ()], np.int64)
            texts = [None if x is None else t for x, t in zip(own, shared.value.decode_all(flat, counts))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(common.tidied(run), StructType([rows.schema["id"]]).add("text", "string")).withColumnRenamed("id", id_col)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
