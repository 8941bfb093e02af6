"""Fingerprints that crowd one segment's value."""

import collections

import numpy as np
import pytest

from newsloom.llm import simhash
from newsloom.llm.components import components


@pytest.mark.parametrize("distance", [2, 3])
def test_a_crowd_of_thousands_loses_no_link(spark, distance):
    """One half in common, the other of few bits, and some whose common half has one bit more."""
    rng = np.random.default_rng(11)
    low = np.unique(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 32, (3000, 9), dtype=np.uint64), axis=1))
    fps = np.unique(np.concatenate([
        low | np.uint64(0xABCD << 40), low[::50] ^ np.uint64((0xABCD << 40) | (1 << 35)), rng.integers(0, 2 ** 63, 200, dtype=np.uint64)]))
    root = np.arange(len(fps))
    links = [(i, j) for i in range(len(fps))
             for j in i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= distance)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    signed = fps.view(np.int64).tolist()
    found = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance).collect()
    assert all(bin((r.a ^ r.b) % 2 ** 64).count("1") <= distance for r in found)
    # Some hundred links for each fingerprint at most, where all pairs would be millions.
    assert len(found) < 600 * len(fps)
    table = spark.createDataFrame([(r.a, r.b) for r in found], "a long, b long")
    roots = {r.node: r.root for r in components(table).collect()}
    want, got = collections.defaultdict(set), collections.defaultdict(set)
    for f, r in zip(signed, root.tolist(), strict=True):
        want[r].add(f)
        got[roots.get(f, f)].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
