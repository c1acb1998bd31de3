"""Encoding of many texts with a public byte-level BPE tokenizer file, with a cache of words.

Byte-level BPE merges within pre-tokens only, and no pre-token holds a white space after
another character. So a text can be cut before every space that stands between two other
characters, and each piece is encoded on its own: once, as long as the cache lasts. Texts are
cut and their pieces numbered by Arrow, so Python sees each distinct piece once a slice; new
pieces are encoded in one call of the library, whose ids fall apart again at the tokens that
begin with a space. Texts with other white space around a space, and texts that hold one of
the file's added tokens, go to the tokenizer whole. The results are those of
``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ids that a process remembers before it starts anew (with their pieces about 300 MB).
REMEMBERED = 4_000_000
#: Pieces that are learnt in one call, and in one text of it (short texts are cheaper).
LEARNT, TOGETHER = 16_384, 128


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path) as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        self.cuts = kind["model"]["type"] == "BPE" and not kind.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = [t["content"] for t in kind.get("added_tokens", [])]
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.size = max(self.whole.get_vocab_size(), max(vocab.values(), default=-1) + 1)
        self.begins = np.zeros(self.size, bool)  # tokens that begin with a space
        self.begins[[i for t, i in vocab.items() if t[:1] == "Ġ"]] = True
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.starts, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        """Pieces neither empty nor with white space at an end, each after a space."""
        for at in range(0, len(pieces), LEARNT):
            part = pieces[at : at + LEARNT]
            joined = [" " + " ".join(part[i : i + TOGETHER]) for i in range(0, len(part), TOGETHER)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(joined, add_special_tokens=False)])
            begin = np.flatnonzero(self.begins[ids])
            if len(begin) != len(part):
                raise ValueError("the tokenizer joins pieces across spaces")
            k = len(self.number)
            while k + len(part) >= len(self.starts):
                self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            self.flat[self.used : self.used + len(ids)] = ids
            self.starts[k : k + len(part)] = self.used + begin
            self.used += len(ids)
            self.starts[k + len(part)] = self.used
            self.number.update(zip(part, range(k, k + len(part))))

    def _numbers(self, distinct: list[str]) -> np.ndarray:
        """The numbers of pieces, new ones learnt; -1 for those that can't stand alone."""
        get = self.number.get
        lacking = [p for p in distinct if p not in self.number and p and not p[0].isspace() and not p[-1].isspace()]
        if lacking:
            self._learn(lacking)
        return np.fromiter((get(p, -1) for p in distinct), np.int64, len(distinct))

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, uint32."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.cuts or not len(column):
            return [self._ids(t) for t in column.to_pylist()]
        if self.used > REMEMBERED:
            self._forget()
        cut = pc.split_pattern(column, " ")
        bounds = np.concatenate(([0], np.cumsum(cut.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        first = np.zeros(len(code), bool)  # a text's first piece stands after no space
        first[bounds[:-1]] = True
        names = coded.dictionary.to_pylist()
        later = np.unique(code[~first])
        number = np.full(len(names), -1, np.int64)
        number[later] = self._numbers([names[i] for i in later.tolist()])
        own = np.where(first, -2, number[code])
        odd = np.zeros(len(column), bool)
        for content in self.added:
            odd |= pc.match_substring(column, content).to_numpy(zero_copy_only=False)
        odd |= np.add.reduceat(own == -1, bounds[:-1]) > 0
        known = np.where(own >= 0, own, 0)
        length = np.where(own >= 0, self.starts[known + 1] - self.starts[known], 0)
        upto = np.concatenate(([0], np.cumsum(length)))
        flat = self.flat[np.arange(upto[-1]) + np.repeat(self.starts[known] - upto[:-1], length)]
        out = []
        for i, (a, b, other) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), odd.tolist())):
            head = names[code[a]]
            if other or b - a > 1 and head[-1:].isspace():
                out.append(self._ids(column[i].as_py()))
            else:
                tail = flat[upto[a] : upto[b]]
                out.append(np.concatenate((self._ids(head), tail)) if head else tail)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
