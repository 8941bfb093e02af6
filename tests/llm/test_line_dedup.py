"""Line dedup against a brute-force version."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from newsloom.llm import line_dedup


def worded(text):
    found = []
    for number, line in enumerate((text or "").split("\n")):
        words = [w for w in re.split("[\x20\x09-\x0d]+", line) if w]
        if words:
            found.append((number, line.strip(" \t\n\r\x0b\x0c"), len(words)))
    return found


def brute(docs, least):
    """docs: (identifier, text) in order. Removed line numbers of each."""
    lines = [worded(t) for _, t in docs]
    windows, first = {}, {}
    for d, rows in enumerate(lines):
        for p in range(len(rows)):
            total, q = 0, p
            while q < len(rows) and total < least:
                total += rows[q][2]
                q += 1
            if total >= least:
                content = tuple(r[1] for r in rows[p:q])
                windows[d, p] = content
                first.setdefault(content, (d, p))
    removed = [set() for _ in docs]
    for (d, p), content in windows.items():
        f, fp = first[content]
        if (f, fp) == (d, p):
            continue
        low, high, g, h = p, p + len(content) - 1, fp, fp + len(content) - 1
        while low and g and lines[d][low - 1][1] == lines[f][g - 1][1]:
            low, g = low - 1, g - 1
        while high + 1 < len(lines[d]) and h + 1 < len(lines[f]) and lines[d][high + 1][1] == lines[f][h + 1][1]:
            high, h = high + 1, h + 1
        removed[d] |= {lines[d][i][0] for i in range(low, high + 1)}
    return removed


def check(spark, docs, least):
    frame = spark.createDataFrame([(i, t, 0, "clash") for i, t in docs], "doc_id long, text string, seq long, h string")
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    removed = brute(ordered, least)
    want = collections.Counter()
    for (i, text), gone in zip(ordered, removed, strict=True):
        rows = (text or "").split("\n")
        want[i, "\n".join(r for n, r in enumerate(rows) if n not in gone), len(rows), tuple(sorted(gone))] += 1
    got = collections.Counter((r.doc_id, r.text, r.n_lines, tuple(r.removed)) for r in line_dedup.line_dedup(frame, words=least).collect())
    assert got == want


def test_small_runs(spark):
    run = "a b\nc d e\nf"
    check(spark, [
        (1, f"start one\n{run}\nend one"), (2, f"other\n  {run}  \n\nend one\nmore"), (3, run), (4, None), (5, ""), (6, "\n \n"),
        (7, "same line here\n" * 6), (8, "a b\nc d e"), (9, "f\nend one"), (10, f"{run}\n{run}"),
        (11, "start one\na b\nc d e\nf\nend one"), (None, "a b\nc d e\nf g")], 5)


def test_repeated_rows_keep_one(spark):
    frame = spark.createDataFrame([(1, "one two three\nfour five six")] * 3, "doc_id long, text string")
    assert sorted(len(r.removed) for r in line_dedup.line_dedup(frame, words=4).collect()) == [0, 2, 2]


def test_long_text_and_empty_table(spark):
    text = "\n".join(f"line {i} of the text" for i in range(4000))
    frame = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    assert [(r.doc_id, len(r.removed)) for r in line_dedup.line_dedup(frame).orderBy("doc_id").collect()] == [(1, 0), (2, 4000)]
    assert line_dedup.line_dedup(frame.filter("false")).count() == 0


@pytest.mark.parametrize("least", [20, line_dedup.MIN_WORDS])
def test_given_documents(spark, small, least):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r.doc_id, r.text) for r in rows], least)
