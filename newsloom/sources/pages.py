"""Stored page snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.urls import snapshot_key
from newsloom.schemas import PAGE
from newsloom.sources.landing import landed


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).parquet(path)


def latest_snapshots(pages: DataFrame) -> DataFrame:
    """One snapshot per key, the last one by ``seq``.

    Superseded pages are found on ``url`` and ``seq`` alone, so that pass does not read any HTML, and removed by
    their unique ``seq``. How that join is made is left to the measured sizes.
    """
    key = snapshot_key(F.col("url"))
    narrow = pages.select(key.alias("_key"), "seq")
    last = narrow.groupBy(F.col("_key").alias("_last_key")).agg(
        F.max("seq").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    superseded = narrow.join(last, F.col("_key") == F.col("_last_key")).filter(F.col("seq") < F.col("_last")).select("seq")
    return pages.join(superseded, "seq", "left_anti").select(key.alias("snapshot_key"), "seq", "url", "html")


def last_pages(pages: DataFrame) -> DataFrame:
    """One page for each ``url``, and for each site if pages have a ``source_url``: the last one by ``seq``; without
    ``seq``, or with equal ones, that of the largest HTML.

    Repeated URLs are found on the narrow columns alone and landed; where there are none, ``pages`` comes back as it is.
    """
    keys = [c for c in ("source_url", "url") if c in pages.columns]
    order = [c for c in ("seq",) if c in pages.columns]
    repeated = landed(pages.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys), "repeated")
    if repeated.isEmpty():
        return pages
    last = pages.join(repeated, keys, "left_semi").groupBy(*keys).agg(F.max(F.struct(*order, "html")).alias("_last"))
    return pages.join(repeated, keys, "left_anti").select(*keys, "html").unionByName(last.select(*keys, "_last.html"))


def write_snapshots(pages: DataFrame, path: str) -> None:
    latest_snapshots(pages).write.mode("error").parquet(path)
