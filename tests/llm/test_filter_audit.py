"""The filter audit against running the filters one after the other."""

import collections
import itertools
import random
import re

from newsloom.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "part string, doc_id long, lang string, text string, bits int, digest string"


def fails(rows):
    """Five booleans for each row."""
    least = {}
    for i, _, text in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    found = []
    for i, _, text in rows:
        text = text or ""
        words = WORD.findall(text)
        found.append((len(words) < 100, 100 * len(set(words)) < 80 * len(words),
                      100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)),
                      i is not None and i > least[text]))
    return found


def brute(rows, labels):
    """One dictionary of counts for each part, order and step, by keeping lists of what is left."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    marks, report = fails(rows), {}
    for part in {p or "" for _, p, _ in rows}:
        inside = [k for k, r in enumerate(rows) if (r[1] or "") == part]
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = inside
            for step, letter in enumerate(order, 1):
                f = "ABCDE".index(letter)
                gone, left = [k for k in left if marks[k][f]], [k for k in left if not marks[k][f]]
                failing = [k for k in inside if marks[k][f]]
                shapley[letter] += len(gone)
                report[part, order, step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(sum(marks[k]) == 1 for k in failing),
                    sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)]
        for (p, order, step), counts in report.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return report


def got(spark, rows, labels):
    docs = spark.createDataFrame([("x", i, p, t, 7, "y") for i, p, t in rows], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {tuple(r[:3]): list(r[3:]) for r in filter_audit.audit(docs, marks).collect()}


def test_against_a_loop(spark):
    rng = random.Random(4)
    texts = [None, "", "A B C", "one # sign", "é" * 30, " ".join(f"w{i}" for i in range(120)), " ".join(["same"] * 150),
             "SHOUT " * 110, " ".join(f"v{i}" for i in range(200)), "x" * 200_000 + " $"]
    texts += [" ".join(rng.choice(["a", "B", f"n{rng.randrange(99)}", "|"]) for _ in range(rng.randrange(90, 140))) for _ in range(40)]
    rows = [(i if rng.random() < 0.9 else None, rng.choice(["en", "de", "", None]), rng.choice(texts)) for i in range(400)]
    rows += rows[:30] + [(r[0], "fr", r[2]) for r in rows[:10]] + [(900 + i, "en", "A B C") for i in range(300)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 800, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (99999, 1, 1)]
    assert got(spark, rows, labels) == brute(rows, labels)


def test_every_order_and_step_is_there(spark):
    report = got(spark, [(1, "en", "A"), (2, None, "b")], [])
    assert len(report) == 2 * 120 * 5
    assert report["", "ABCDE", 5] == [0, 0, 0, 0, 0, 0, 0]


def test_empty_table(spark):
    assert got(spark, [], [(1, 1, 1)]) == {}


def test_copies_are_combined_before_they_meet(spark):
    """One text on most rows: what is shuffled by digest alone are sums, one row for each part and label."""
    rows = [(i, "en", "copy") for i in range(2000)] + [(5000 + i, "de", f"t{i}") for i in range(10)]
    docs = spark.createDataFrame([("x", i, p, t, 7, "y") for i, p, t in rows], SCHEMA)
    judged = filter_audit.judged(docs, "doc_id", "text", "lang")
    cells = filter_audit.cells(judged, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert sorted((r.part, r["mask"], r.n) for r in cells if r.n) == [("de", 1, 10), ("en", 1, 1), ("en", 17, 1999)]
