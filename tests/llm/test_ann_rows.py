"""Every row is a candidate by itself, whatever identifiers repeat and however many lengths there are."""

import collections

import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import ann

SCHEMA = "vec_id long, embedding array<double>"


def exact(rows, nearest=5):
    """All rows by brute force: sorted answers of each query row as one multiset."""
    answers = collections.Counter()
    for q, (query, vector) in enumerate(rows):
        if query % 50:
            continue
        a = np.array(vector)
        scores = []
        for c, (vec_id, other) in enumerate(rows):
            if c != q and len(other) == len(vector):
                b = np.array(other)
                scores.append((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 9), vec_id))
        answers.update((query, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:nearest], 1))
    return answers


def found(spark, rows, **how):
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = ann.nearest_neighbours(vectors, F.col("vec_id") % 50 == 0, **how).collect()
    return collections.Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got)


def test_rows_with_one_identifier_stay_apart(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (2, [1.0, 0.01]), (50, [1.0, 0.02])]
    assert found(spark, rows) == exact(rows)


def test_repeated_queries_leave_out_only_their_own_row(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0])]
    assert found(spark, rows) == exact(rows)


def test_more_lengths_than_pivots(spark):
    rng = np.random.default_rng(3)
    rows = [(50 * (3 * size + n) + spare, [float(x) for x in rng.normal(size=size)])
            for size in range(2, 42) for n in range(3) for spare in range(4)]
    assert found(spark, rows, pivots=16) == exact(rows)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "INDEX_BLOCK", 40)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    assert found(spark, rows) == exact(rows)
