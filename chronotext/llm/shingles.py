"""Hashes of word shingles of whole texts, in numpy, for use inside tasks.

Texts come as Arrow string columns and are worked on in slices of about SLICE bytes, so
memory does not grow with the batch; a longer text is a slice of its own. A word is a run of
bytes other than white space with A-Z read as a-z. A shingle is ``width`` words in a row; a
text of fewer words is one shingle of all of them, and a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
SLICE = 1 << 20

_rng = np.random.default_rng(20_240_501)
#: Random 64-bit values for bytes, and odd multipliers for places of bytes and words.
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = np.uint64(int(_rng.integers(0, 2**63)) * 2 + 1)
_PLACE_BACK = np.uint64(pow(int(_PLACE), -1, 2**64))
_WORD = np.uint64(int(_rng.integers(0, 2**63)) * 2 + 1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    """base ** 0 ... base ** (n - 1); kept for slices, made anew for longer texts."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= SLICE:
            _powers[name] = have
    return have[:n]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, last byte, hash) of each word of data, which holds texts that begin at
    the offsets at."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]  # a text's first byte begins a word even if the one before is no space
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    if not len(begin):
        return begin, end, np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_PLACE, len(data), "place"), out=sums[1:])
        words = (sums[end + 1] - sums[begin]) * _power(_PLACE_BACK, len(data), "back")[begin]
        return begin, end, mixed(words + (end - begin + 1).astype(np.uint64) * _WORD)


def hashes(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes text by text, their number in each text) of the texts
    data[offsets[i]:offsets[i + 1]], repeated shingles included."""
    n_texts = len(offsets) - 1
    data = data[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(n_texts, np.int64)
    begin, end, words = word_hashes(data, at)
    if not len(begin):
        return np.empty(0, np.uint64), np.zeros(n_texts, np.int64)
    with np.errstate(over="ignore"):
        bounds = np.searchsorted(begin, at)
        counts = np.diff(bounds)
        whole = np.zeros(0, np.uint64)
        if len(words) >= width:
            for j in range(width):
                part = words[j : len(words) - width + 1 + j]
                whole = part.copy() if j == 0 else whole * _WORD + part
            whole = mixed(whole)
        made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
        starts = np.zeros(n_texts, np.int64)
        np.cumsum(made[:-1], out=starts[1:])
        # the shingle at each output place: its text's first word plus the place within the text
        owner_shift = np.repeat(bounds[:-1] - starts, made)
        word_at = np.arange(made.sum()) + owner_shift
        out = np.empty(made.sum(), np.uint64)
        long_enough = np.repeat(counts >= width, made)
        if len(whole):
            out[long_enough] = whole[word_at[long_enough]]
        for n in range(1, width):
            short = counts == n
            if short.any():
                b = bounds[:-1][short]
                h = words[b]
                for j in range(1, n):
                    h = h * _WORD + words[b + j]
                out[starts[short]] = mixed(h + np.uint64(n))
    return out, made


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without nulls."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def distinct(found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes in ascending order, without repeats, and their numbers."""
    out, numbers, at = [], np.zeros(len(counts), np.int64), 0
    for i, n in enumerate(counts.tolist()):
        if n:
            own = np.sort(found[at : at + n])
            if n > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            out.append(own)
            numbers[i] = len(own)
            at += n
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), numbers
