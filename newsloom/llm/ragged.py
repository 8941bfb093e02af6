"""Lists of numbers by name, held in flat arrays so that whole texts are put together by gathers."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence

import numpy as np
import xxhash

# Digests that are held as Python objects at a time.
PART = 1 << 16


def spread(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``first, first + 1, ...`` of each list, one list after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(first - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Ragged:
    """Grows by blocks; names are numbered in the order they come."""

    def __init__(self, dtype) -> None:
        self.number: dict = {}
        self.first, self.length = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, dtype)

    def __len__(self) -> int:
        return len(self.number)

    def missing(self, names: set) -> list:
        return [n for n in names if n not in self.number]

    def add(self, names: Sequence, lengths: np.ndarray, flat: np.ndarray) -> None:
        self.number.update(zip(names, range(len(self.number), len(self.number) + len(names)), strict=True))
        self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(lengths) - lengths))
        self.length = np.concatenate((self.length, lengths))
        self.flat = np.concatenate((self.flat, flat.astype(self.flat.dtype)))

    def numbers(self, names: Sequence) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.first[numbers], self.length[numbers])]


class Digests:
    """Finds words of a fixed list by 128-bit digests, in 16 bytes a word and without the words themselves."""

    def __init__(self, words: Iterable[str]) -> None:
        digests = self._of(words)
        self.row = np.argsort(digests[:, 0], kind="stable").astype(np.int32)
        self.high, self.low = digests[self.row, 0], digests[self.row, 1]

    @staticmethod
    def _of(words: Iterable[str]) -> np.ndarray:
        words, found = iter(words), [np.empty(0, np.uint64)]
        while part := [xxhash.xxh128_digest(w.encode("utf-8", "surrogatepass")) for w in itertools.islice(words, PART)]:
            found.append(np.frombuffer(b"".join(part), ">u8").astype(np.uint64))
        return np.concatenate(found).reshape(-1, 2)

    def find(self, words: Sequence[str]) -> np.ndarray:
        """The place of each word in the list, -1 where it is not in it."""
        if not len(self.row):
            return np.full(len(words), -1, np.int64)
        digests = self._of(words)
        at = np.minimum(np.searchsorted(self.high, digests[:, 0]), len(self.row) - 1)
        same = (self.high[at] == digests[:, 0]) & (self.low[at] == digests[:, 1])
        return np.where(same, self.row[at], -1).astype(np.int64)
