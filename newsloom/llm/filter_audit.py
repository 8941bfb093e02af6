"""How filters interact: what each removes in every order of all of them.

Five conditions are judged once for each document. Their outcomes, pass or fail, make a table of two to the
power of five counts for each part. Each step of each order then is a contraction of that tensor: along an axis
it takes the passing half for a filter that ran before, the failing half for the filter that runs, and both for
those still to come.

Scale: one pass over the texts; then narrow rows. Copies are found by digest in sums that are combined before
they are shuffled, so a text that makes up a third of all rows is a few rows for each task. A part's tensor
has 32 cells, whatever the number of its documents.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import WORD, or_blank, written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 100, 80, 10, r"[#$%&*|]"
SALTS = 64
COUNTS = ("n", "good", "toxic")
REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def own_failures(text: Column) -> Column:
    """Bits 0 to 3: few words, few distinct words, many capitals, signs. The words are found once."""
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    counts = F.transform(F.array(words), lambda w: F.struct(
        F.size(w).cast("long").alias("all"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))
    few = F.transform(counts, lambda c: (c["all"] < LEAST_WORDS).cast("int")
                      + 2 * (100 * c["distinct"] < LEAST_DISTINCT * c["all"]).cast("int"))[0]
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return (few + 4 * (100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long")).cast("int")
            + 8 * F.rlike(text, F.lit(SIGNS)).cast("int"))


def judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Narrow rows of all documents, written once: ``doc_id, part, bits, digest``."""
    text = or_blank(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), or_blank(F.col(part_col)).alias("part"),
        own_failures(text).alias("bits"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return written(rows, "audit-judged")


def label_flags(labels: DataFrame) -> DataFrame:
    """``doc_id, good, toxic``: one row for each labelled identifier; of several labels any one counts."""
    return labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic`` with all five bits in ``mask``.

    Equal texts have equal bits, so copies differ only in identifier, part and labels. Of each text the
    rows of its smallest identifier pass the last filter, and those without an identifier, as no row is smaller.
    """
    repeats = rows.groupBy("digest", "doc_id", "part", "bits").agg(F.count(F.lit(1)).alias("n"))
    # Rows without an identifier meet no label; their salt keeps them from meeting in one task.
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.hash("digest"), F.lit(SALTS))).otherwise(0)
    labelled = repeats.withColumn("salt", salt).join(
        label_flags(labels).withColumn("salt", F.lit(0)), ["doc_id", "salt"], "left").fillna(0, ["good", "toxic"])
    groups = written(labelled.groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("named"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed")), "audit-groups")
    first = groups.groupBy("digest").agg(F.min("least").alias("first"))
    passing = F.when(F.col("least") == F.col("first"), F.col("named")).otherwise(0) + F.col("unnamed")
    counted = groups.join(first, "digest").withColumn("passing", passing)
    outcomes = F.array(
        F.struct(F.col("bits").alias("mask"), F.col("passing").alias("n")),
        F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    return counted.select("part", "good", "toxic", F.inline(outcomes)).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
        F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _selectors() -> tuple[list[str], np.ndarray]:
    """All orders, and for each order and step which half of each axis counts: order, step, axis, (pass, fail)."""
    orders = list(itertools.permutations(range(len(FILTERS))))
    chosen = np.ones((len(orders), len(FILTERS), len(FILTERS), 2), np.int64)
    for i, order in enumerate(orders):
        for step, filter_ in enumerate(order):
            chosen[i, step, filter_, 0] = 0
            chosen[i, step + 1:, filter_, 1] = 0
    return ["".join(FILTERS[f] for f in order) for order in orders], chosen


def contract(tensors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Sums of each of ``tensors`` (count, then one axis for each filter) under every selection of halves."""
    return np.einsum("tabcde,na,nb,nc,nd,ne->nt", tensors, *np.moveaxis(chosen, 1, 0))


def part_report(part: str, mask: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """All orders and steps of one part from the counts of its cells, one row of ``counts`` for each of COUNTS."""
    size = len(FILTERS)
    flat = np.zeros((len(counts), 2 ** size), np.int64)
    flat[:, mask] = counts
    # The first filter is the lowest bit and becomes the first axis.
    tensors = flat.reshape(-1, *[2] * size).transpose(0, *range(size, 0, -1))
    orders, chosen = _selectors()
    removed = contract(tensors, chosen.reshape(-1, size, 2)).reshape(len(orders), size, -1)
    at = np.array([[FILTERS.index(f) for f in order] for order in orders])
    every = np.ones((size, size, 2), np.int64)
    every[np.arange(size), np.arange(size), 0] = 0
    alone = np.zeros_like(every)
    alone[:, :, 0] = 1
    alone[np.arange(size), np.arange(size)] = (0, 1)
    failing, only = contract(tensors, every)[:, 0], contract(tensors, alone)[:, 0]
    total = int(flat[0].sum())
    by_filter = np.zeros(size, np.int64)
    np.add.at(by_filter, at.ravel(), removed[:, :, 0].ravel())
    return pd.DataFrame({
        "part": part, "filter_order": np.repeat(orders, size), "step": np.tile(np.arange(1, size + 1), len(orders)),
        "kept": (total - np.cumsum(removed[:, :, 0], axis=1)).ravel(), "removed": removed[:, :, 0].ravel(),
        "redundant": (failing[at] - removed[:, :, 0]).ravel(), "unique_fails": only[at].ravel(),
        "good_lost": removed[:, :, 1].ravel(), "toxic_lost": removed[:, :, 2].ravel(), "shapley": by_filter[at].ravel()})


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """One row for each part, each order of the five filters and each step, zeros included; see REPORT.

    Null texts count as empty, null parts as the empty part, together with that part's own rows. Repeated rows
    count one by one. A row without an identifier never fails the filter of copies, makes no other row fail it and
    has no labels. Labels without a document count nothing. An empty table has no parts and gives no rows; other
    columns are not read.
    """
    def report(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        return part_report(key[0], cell["mask"].to_numpy(), cell[list(COUNTS)].to_numpy(np.int64).T)

    return cells(judged(docs, id_col, text_col, part_col), labels).groupBy("part").applyInPandas(report, REPORT)
