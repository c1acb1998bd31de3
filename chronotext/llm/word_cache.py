"""A growing table word -> ids, for encoders that work word by word inside a task."""

from __future__ import annotations

import numpy as np


class WordCache:
    def __init__(self):
        self.number: dict[str, int] = {}
        self.held = 0  # bytes, about
        self._starts, self._flat, self._used = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def __len__(self) -> int:
        return len(self.number)

    def add(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Words that are not there yet, with their ids one after another, counts[i] of them each."""
        k = len(self.number)
        while k + len(words) + 1 > len(self._starts):
            self._starts = np.concatenate((self._starts, np.zeros_like(self._starts)))
        while self._used + len(ids) > len(self._flat):
            self._flat = np.concatenate((self._flat, np.zeros_like(self._flat)))
        self._flat[self._used : self._used + len(ids)] = ids
        self._starts[k + 1 : k + len(words) + 1] = self._used + np.cumsum(counts)
        self._used += len(ids)
        self.number.update(zip(words, range(k, k + len(words))))
        self.held += 120 * len(words) + sum(map(len, words)) + 4 * len(ids)

    def ids(self, numbers: list[int]) -> np.ndarray:
        """The ids of words, by their numbers, one after another."""
        k = np.array(numbers, np.int64)
        begin = self._starts[k]
        length = self._starts[k + 1] - begin
        ends = np.cumsum(length)
        places = np.arange(int(ends[-1]) if len(k) else 0) + np.repeat(begin - (ends - length), length)
        return self._flat[places]
