"""The manifest against trees built from sorted lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from test_edge_cases import lowered

from newsloom.llm import merkle

SCHEMA = "idx string, doc_id long, source string, lang string, n_chars long, text string, tree int"
ROWS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        last = found[-1]
        found.append([digest("".join(last[i:i + 8])) for i in range(0, len(last), 8)])
    return found


def siblings(tower, at):
    path = []
    for nodes in tower[:-1]:
        start = at - at % 8
        path.append(("".join(nodes[start:at]), "".join(nodes[at + 1:start + 8])))
        at //= 8
    return path


def brute(rows):
    """All output rows, from rows as tuples of the covered fields."""
    groups = {}
    for row in rows:
        tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None
        claimed = leaf((*row[:4], lowered(row[4]))) if tampered else leaf(row)
        groups.setdefault(row[2], []).append((row[0], leaf(row), claimed))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    towers = {name: levels([r[1] for r in groups[name]]) for name in names}
    crown = levels([towers[name][-1][0] for name in names]) if names else []
    found = []
    for number, name in enumerate(names):
        for at, (doc_id, node, claimed) in enumerate(groups[name]):
            path = siblings(towers[name], at) + siblings(crown, number)
            folded = claimed
            for left, right in path:
                folded = digest(left + folded + right)
            found.append((doc_id, node, towers[name][-1][0], crown[-1][0], digest("".join(a + b for a, b in path)),
                          folded, folded == crown[-1][0]))
    return sorted(found, key=repr)


def got(spark, rows, parts=3):
    docs = spark.createDataFrame([("x", *r, 1) for r in rows], SCHEMA).repartition(parts)
    found = merkle.manifest(docs, merkle.lowered_for_a_third(F.col("doc_id"), F.col("text")))
    return sorted(map(tuple, found.withColumn("proof", F.sha2("proof", 256)).collect()), key=repr)


def made(count, rng, langs):
    ids = rng.sample(range(-10 * count, 10 * count), count)
    return [(i, rng.choice(["s", None, ""]), rng.choice(langs), rng.choice([None, 3]), rng.choice([None, "", f"Text {i} É", "low"]))
            for i in ids]


@pytest.mark.parametrize("count", [1, 2, 8, 9, 64, 65, 512, 513])
def test_one_tree_of_any_size(spark, count):
    rows = [(i, "s", "en", i, f"T{i}") for i in range(count)]
    assert got(spark, rows) == brute(rows)


def test_many_groups_sparse_and_missing_identifiers(spark):
    rng = random.Random(6)
    rows = made(1500, rng, ["en", "en", "en", "de", None, "", "ß", "+"]) + [
        (2 ** 62, "s", "en", 1, "Far"), (-2 ** 62, "s", "en", 1, "Far"), (2 ** 63 - 1, None, None, None, None), (63, "s", "x", 1, "A")]
    rows += [(None, "s", "en", 1, f"t{i}") for i in range(20)] + [(None, None, None, None, None)]
    assert got(spark, rows) == brute(rows)


def test_repeated_identifiers_and_rows(spark):
    rng = random.Random(7)
    rows = made(200, rng, ["en", None])
    rows += [(5, "s", "en", 1, "one row Many times")] * 700 + [(5, "s", "en", 1, f"text {i}") for i in range(600)]
    rows += [(7, "s", "en", 1, "b"), (7, "s", None, 1, "b")] + rows[:40]
    assert got(spark, rows, 5) == brute(rows)


def test_groups_without_end(spark):
    """Every row a group of its own: the tree of groups has several levels."""
    rows = [(i, "s", f"lang{i}", 1, "Word" * (i % 4)) for i in range(700)]
    assert got(spark, rows) == brute(rows)


def test_nothing_claimed_is_verified(spark):
    rows = [(i, "s", "en", i, f"T{i}") for i in range(100)]
    docs = spark.createDataFrame([("x", *r, 1) for r in rows], SCHEMA)
    assert merkle.manifest(docs).filter("verified").count() == 100
    other = merkle.manifest(docs, F.when(F.col("doc_id") == 3, "T4").otherwise(F.col("text"))).collect()
    assert [r.doc_id for r in other if not r.verified] == [3]


def test_empty_table(spark):
    assert got(spark, []) == []


def test_leaves_are_not_sorted_for_their_places(spark):
    """Ranks come from words of 64 identifiers; no window or sort is over leaves."""
    docs = spark.range(5000).select(
        "id", F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"),
        F.lit("t").alias("text"))
    leaves = docs.select(merkle.tree_name(F.col("lang")).alias("tree"), F.col("doc_id").alias("ident"), "doc_id",
                         F.lit("n").alias("node"), F.lit("c").alias("claimed"), F.lit(0).alias("part"))
    found = merkle.ranked(leaves)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    assert sorted((r.doc_id, r.idx, r.total) for r in found.collect()) == [(i, i, 5000) for i in range(5000)]
    assert merkle.bitmaps(leaves).count() == 79
