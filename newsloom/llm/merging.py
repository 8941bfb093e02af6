"""Byte-pair merges of many short sequences at once, in ragged numpy arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

NO_RANK = np.iinfo(np.int64).max
WIDTH = np.int64(1 << 20)


class MergeTable:
    """Which neighbouring symbols merge, in which order, and into what. Sorted by pair for binary search."""

    def __init__(self, left: Sequence[int], right: Sequence[int], rank: Sequence[int], merged: Sequence[int]) -> None:
        key = np.asarray(left, np.int64) * WIDTH + np.asarray(right, np.int64)
        order = np.argsort(key)
        self.key = key[order]
        self.rank = np.asarray(rank, np.int64)[order]
        self.merged = np.asarray(merged, np.int64)[order]

    def look_up(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol and its right neighbour: the rank of the merge (NO_RANK: none) and its place."""
        key = symbols[:-1] * WIDTH + symbols[1:]
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        rank = np.full(len(symbols), NO_RANK)
        rank[:-1] = np.where(self.key[place] == key, self.rank[place], NO_RANK)
        return rank, place


def merge_all(sequences: Sequence[Sequence[int]], table: MergeTable) -> list[np.ndarray]:
    """Every sequence after all merges.

    In each round every sequence applies its lowest-ranked pair at all places of that pair, from the left
    where places overlap. Sequences without a pair leave, so a round costs what is still unfinished.
    """
    done: list[np.ndarray] = [np.empty(0, np.int64)] * len(sequences)
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    names = np.flatnonzero(lengths)
    lengths = lengths[names]
    if not len(names) or not len(table.key):
        return [np.asarray(s, np.int64) for s in sequences]
    symbols = np.concatenate([np.asarray(sequences[i], np.int64) for i in names])
    while len(names):
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        rank, place = table.look_up(symbols)
        rank[starts[1:] - 1] = NO_RANK
        lowest = np.minimum.reduceat(rank, starts)
        open_ = lowest != NO_RANK
        if not open_.all():
            for i in np.flatnonzero(~open_):
                done[names[i]] = symbols[starts[i]:starts[i] + lengths[i]].copy()
            keep = np.repeat(open_, lengths)
            place = np.append(place, 0)[keep][:-1] if keep.any() else place[:0]
            symbols, rank = symbols[keep], rank[keep]
            names, lengths, lowest = names[open_], lengths[open_], lowest[open_]
            if not len(names):
                break
        at = np.flatnonzero(rank == np.repeat(lowest, lengths))
        # Within a run of neighbouring places every other one merges.
        first = np.concatenate(([True], np.diff(at) != 1))
        run = np.maximum.accumulate(np.where(first, at, 0))
        at = at[(at - run) % 2 == 0]
        symbols[at] = table.merged[place[at]]
        ends = np.cumsum(lengths)
        lengths = lengths - np.diff(np.concatenate(([0], np.searchsorted(at, ends))))
        symbols = np.delete(symbols, at + 1)
    return done
