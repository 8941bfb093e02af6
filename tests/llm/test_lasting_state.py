"""Exact dedup over several calls with one state folder, against a brute-force version over all rows so far."""

import collections

import pytest
from pyspark.sql import functions as F

from newsloom.llm import exact_dedup

CALLS = [
    [(1, "The same"), (5, "the SAME"), (2, "alone"), (None, "no identifier"), (3, None)],
    [],
    [(4, "THE same"), (9, "later"), (7, "alone"), (7, "alone"), (8, "ALONE"), (None, "No identifier")],
    [(6, "the same"), (10, ""), (11, "new"), (9, "Later")],
]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def weak(content):
    return F.unhex(F.lpad(F.hex(F.length(content) % 2), 8, "0"))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
def test_later_calls_meet_the_rows_of_earlier_ones(spark, tmp_path, digest):
    seen, kept_so_far = [], collections.Counter()
    for rows in CALLS:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = exact_dedup.exact_dedup(docs, digest=digest, state=str(tmp_path / "state")).collect()
        seen += rows
        groups = collections.defaultdict(list)
        for i, text in seen:
            groups[lowered(text)].append(i)
        keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == collections.Counter(
            (i, keep[lowered(t)], len(groups[lowered(t)])) for i, t in rows)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
        kept_so_far.update(r.doc_id for r in got if r.kept)
    # The last one of each group was kept by some call, and once.
    assert all(kept_so_far[i] == 1 for i in keep.values())


def test_a_new_folder_knows_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "A")], "doc_id long, text string")
    for name in ("one", "two"):
        got = exact_dedup.exact_dedup(docs, state=str(tmp_path / name)).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 2, 2, False), (2, 2, 2, True)]
