"""Connected components of a table of links, by alternating large and small stars.

Each round points every node's larger neighbours, then its smaller ones, at the smallest node it knows of,
until the links form stars around the smallest node of each component. Rounds grow with the logarithm of
the number of nodes. Links are written to the shared folder after each round; only a count and a checksum
come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u AND v <> m").select(
        F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    pairs = links.join(least, "a").select(F.inline(F.array(
        F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
    return pairs.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every linked node but the roots; ``root`` is the smallest node that is reachable.

    ``links`` has ``a`` and ``b`` (long). Loops, nulls and repeated links are ignored.
    """
    links = written(links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(links)
    while before[0]:
        links = written(_small_star(_large_star(links)), "links")
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
