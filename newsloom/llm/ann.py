"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots, in order. The index posts every vector, with the place that
the pivot has in its order, to the inverted file of each of those pivots. For a query the files of its own
pivots are read: every posting adds how near the two places are, which is the footrule distance of the two
orders with absent pivots at the end. The best share of the postings is reranked by exact cosine.

Scale: equal vectors are one entry of the index and one query, whatever their number; an entry carries as
many rows as a result can hold. Pivots are a bounded sample of the distinct vectors of each length, chosen and
applied in tasks. The index is dealt out in blocks by a hash, the queries in blocks too; each block of
queries meets each block of the index in a task of its own, ranks there, and hands on its best few, so no
task grows with the tables. The work is queries times rows by nature.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import written

PIVOTS = 256
KEPT = 64
SHARE = 0.1
LEAST = 256
# Entries as near by footrule as this part of the nearest possible are candidates too, however many: in a
# crowd of almost equal vectors the orders alone do not tell who is nearest.
CROWD = 0.75
NEAREST = 5
OFFERED = 4
VERY_NEAR = 0.9
INDEX_BLOCK = 8192
QUERY_BLOCK = 1024


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, row, vector`` of the rows that can take part: no null, zero or non-finite vector, no null
    identifier. Rows that share an identifier stay apart by their number ``row``."""
    value = F.col(vector_col).cast("array<double>")
    usable = F.forall(value, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(
        value, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), value.alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False))).select(
        "vec_id", F.monotonically_increasing_id().alias("row"), "vector")


def distinct_vectors(rows: DataFrame, members: int) -> DataFrame:
    """Each distinct vector under the number of one of its rows, with its first few rows by identifier:
    ``entry, dims, spread, vector, members, member_rows``; ``spread`` is a hash of the vector."""
    order = Window.partitionBy("vector").orderBy("vec_id", "row")
    first = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= members)
    grouped = first.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("_m"))
    return grouped.select(
        F.col("_m")[0]["row"].alias("entry"), F.size("vector").alias("dims"), F.xxhash64("vector").alias("spread"),
        "vector", F.col("_m.vec_id").alias("members"), F.col("_m.row").alias("member_rows"))


def _unit(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def choose_pivots(entries: DataFrame, count: int) -> DataFrame:
    """``dims, number, pivot``: up to ``count`` pivots for each number of dimensions, chosen in a task of its own
    from OFFERED times as many entries, those of the smallest hash. Almost equal pivots would take each
    other's places in every order, so a pivot that is very near an earlier one is passed over while there
    are others."""
    order = Window.partitionBy("dims").orderBy("spread", F.col("members")[0])
    sample = entries.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= OFFERED * count)

    def choose(sampled: pd.DataFrame) -> pd.DataFrame:
        sampled = sampled.sort_values("_n")
        offered = _unit(np.stack(sampled["vector"].to_numpy()))
        apart: list[int] = []
        for i in range(len(offered)):
            if len(apart) < count and not (offered[apart] @ offered[i] > VERY_NEAR).any():
                apart.append(i)
        rest = [i for i in range(len(offered)) if i not in set(apart)]
        chosen = offered[(apart + rest)[:count]]
        return pd.DataFrame({"dims": sampled["dims"].iloc[0], "number": range(len(chosen)), "pivot": list(chosen)})

    return sample.select("dims", "_n", "vector").groupBy("dims").applyInPandas(
        choose, "dims int, number int, pivot array<double>")


def every(count: str):
    """All block numbers below the column ``count``."""
    return F.explode(F.sequence(F.lit(0), F.col(count) - 1))


def own(count: str):
    return F.pmod(F.col("spread"), F.col(count)).cast("int")


def with_order(entries: DataFrame, pivots: DataFrame, shapes: DataFrame, kept: int) -> DataFrame:
    """``entries`` by blocks of the index, with the numbers of their nearest pivots, nearest first. Each block
    meets the pivots of its dimensions, so no task or broadcast holds those of every length."""
    def run(block: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame(columns=[*columns, "pivots"])
        chosen = np.stack(near.sort_values("number")["pivot"].to_numpy())
        away = -(_unit(np.stack(block["vector"].to_numpy())) @ chosen.T)
        orders = np.argsort(away, axis=1, kind="stable")[:, :kept].astype(np.int16)
        return block[columns].assign(pivots=list(orders))

    columns = ["entry", "dims", "spread", "vector", "members", "member_rows", "i"]
    blocks = entries.join(shapes, "dims").select(*columns[:-1], own("index_blocks").alias("i"))
    dealt = pivots.join(shapes, "dims").select(
        F.col("dims").alias("size"), every("index_blocks").alias("block"), "number", "pivot")
    return blocks.groupBy("dims", "i").cogroup(dealt.groupBy("size", "block")).applyInPandas(
        run, "entry long, dims int, spread long, vector array<double>, members array<long>, "
             "member_rows array<long>, i int, pivots array<smallint>")


class Postings:
    """One block of the index: its entries, and for each pivot who has it and at which place."""

    def __init__(self, block: pd.DataFrame) -> None:
        self.first = np.array([m[0] for m in block["members"]])
        at = np.lexsort((block["spread"].to_numpy(), self.first))
        block, self.first = block.iloc[at], self.first[at]
        self.members, self.rows = block["members"].to_list(), block["member_rows"].to_list()
        self.vectors = np.stack(block["vector"].to_numpy())
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        orders = np.stack(block["pivots"].to_numpy())
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.row = (by_pivot // orders.shape[1]).astype(np.int32)
        self.place = (by_pivot % orders.shape[1]).astype(np.int32)
        self.kept = orders.shape[1]
        self.start = np.searchsorted(flat[by_pivot], np.arange(int(flat.max()) + 2))

    def nearness(self, order: np.ndarray) -> np.ndarray:
        """Places in common less the footrule between them; larger is nearer."""
        total = np.zeros(len(self.first), np.int64)
        for place, pivot in enumerate(order):
            if pivot + 1 < len(self.start):
                file = slice(self.start[pivot], self.start[pivot + 1])
                total[self.row[file]] += self.kept - np.abs(self.place[file] - place)
        return total

    def nearest(self, vector: np.ndarray, order: np.ndarray, count: int, share: float, least: int):
        """The best ``count`` rows by exact cosine, ties to smaller identifiers, among the members of the best
        ``share`` of entries by footrule and of the crowd."""
        size = len(self.first)
        wanted = min(size, max(least, int(np.ceil(share * size))))
        near = self.nearness(order)
        rank = near * size + np.arange(size - 1, -1, -1)
        rows = np.union1d(np.argpartition(-rank, wanted - 1)[:wanted], np.flatnonzero(near >= CROWD * self.kept ** 2))
        dots = np.einsum("ij,j->i", self.vectors[rows], vector)
        scores = dots / (self.norms[rows] * np.sqrt(np.einsum("i,i->", vector, vector)))
        best = np.lexsort((self.first[rows], -scores))[:count]
        return sorted((-scores[b], int(m), int(r)) for b in best for m, r in zip(
            self.members[rows[b]], self.rows[rows[b]], strict=True))[:count]


def nearest_neighbours(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding",
                       nearest: int = NEAREST, pivots: int = PIVOTS, kept: int = KEPT, share: float = SHARE,
                       least: int = LEAST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows found for every row that ``is_query`` selects.

    ``is_query`` is a condition on the column ``vec_id``. Nearness is the cosine, in double precision, of the
    vectors as given; ties go to the smaller identifier. Rows whose vector is null, zero, or holds null or
    non-finite components take no part, nor do null identifiers. Rows that share an identifier are
    candidates each by itself, and each of them is a query that leaves out only its own row. Only vectors
    of as many dimensions are compared, of however many lengths. With fewer candidates than asked for, all
    come back. Empty tables give an empty result. ``share`` and ``least`` bound the entries that are
    reranked in each block of the index: recall against brute force depends on them and is measured in the
    tests.
    """
    rows = written(valid_vectors(vectors, id_col, vector_col), "ann-vectors")
    entries = written(distinct_vectors(rows, nearest + 1), "ann-entries")
    asked = written(rows.filter(is_query).join(entries.select("vector", "entry"), "vector").select(
        F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), "entry"), "ann-queries")
    searched = asked.select("entry", F.lit(1).alias("is_searched")).distinct()
    shapes = written(entries.select("entry", "dims").join(searched, "entry", "left").groupBy("dims").agg(
        F.ceil(F.count("entry") / INDEX_BLOCK).cast("int").alias("index_blocks"),
        F.ceil(F.count("is_searched") / QUERY_BLOCK).cast("int").alias("query_blocks")).filter(
        "query_blocks > 0"), "ann-shapes")
    index = written(with_order(entries, choose_pivots(entries, pivots), shapes, kept), "ann-index")

    placed = index.join(shapes, "dims")
    blocks = placed.select("dims", "i", every("query_blocks").alias("q"), "spread", "vector", "members",
                           "member_rows", "pivots")
    queries = placed.join(searched.select("entry"), "entry", "left_semi").select(
        F.col("dims").alias("size"), every("index_blocks").alias("block"), own("query_blocks").alias("part"), "entry",
        F.col("vector").alias("asked"), F.col("pivots").alias("order"))

    def search(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(block) and len(wanted):
            postings = Postings(block)
            for entry, vector, order in zip(wanted["entry"], wanted["asked"], wanted["order"], strict=True):
                near = postings.nearest(vector, order, nearest + 1, share, least)
                found.extend((entry, member, row, -less) for less, member, row in near)
        return pd.DataFrame(found, columns=["entry", "vec_id", "row", "score"])

    met = blocks.groupBy("dims", "i", "q").cogroup(queries.groupBy("size", "block", "part")).applyInPandas(
        search, "entry long, vec_id long, row long, score double")
    per_entry = Window.partitionBy("entry").orderBy(F.desc("score"), "vec_id", "row")
    best = met.withColumn("_n", F.row_number().over(per_entry)).filter(F.col("_n") <= nearest + 1)
    per_query = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    answers = asked.join(best, "entry").filter(F.col("query_row") != F.col("row"))
    return answers.withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= nearest).select(
        "query_id", "rank", "vec_id", "score")
