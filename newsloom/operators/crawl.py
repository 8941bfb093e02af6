"""Filling site quotas from several extractors, and the statistics of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.quality import usable
from newsloom.operators.ranking import first_n_per_group

# Extractors in the order they are tried, and how far the first one reads ahead.
METHODS = ("main", "fallback", "rendered")
READ_AHEAD = 3


def largest_quota(sites: DataFrame) -> int:
    """One number off the request table; it bounds how many rows of a site can matter. A site that is
    requested more than once may have the sum of its quotas."""
    return site_quotas(sites).agg(F.coalesce(F.max("quota"), F.lit(0))).first()[0]


def site_quotas(sites: DataFrame) -> DataFrame:
    return sites.groupBy("source_url").agg(F.sum("quota").alias("quota"))


def only_usable(events: DataFrame, minimum: int = 200) -> DataFrame:
    return events.filter(usable(F.col("content"), F.col("headline"), minimum))


def with_quota(ranked: DataFrame, sites: DataFrame, factor: int = 1) -> DataFrame:
    """Rows whose position is within their site's own quota. Comes after the cut to the largest quota,
    so each site brings few rows to the join, however big it is."""
    quotas = site_quotas(sites).withColumnRenamed("quota", "_quota")
    return ranked.join(quotas, "source_url").filter(
        F.col("rank") <= F.col("_quota") * factor).drop("_quota", "rank")


def read_ahead(events: DataFrame, sites: DataFrame, bound: int | None = None) -> DataFrame:
    """What the first extractor hands on: three times the quota, counted over pages that had any text but
    before any filter for usable ones."""
    limit = READ_AHEAD * (largest_quota(sites) if bound is None else bound)
    ranked = first_n_per_group(
        events.filter(F.col("content") != ""), ["source_url"], [F.col("pos"), F.col("article_url")], limit, ["article_url", "pos"])
    return with_quota(ranked, sites, READ_AHEAD)


def fill_quota(events: DataFrame, sites: DataFrame, bound: int | None = None) -> DataFrame:
    """Usable ``events`` of all extractors, in order of ``priority`` and ``pos``, up to each quota.

    Articles found by two extractors are taken twice, later removed as duplicates.
    """
    limit = largest_quota(sites) if bound is None else bound
    ranked = first_n_per_group(
        events, ["source_url"], [F.col("priority"), F.col("pos"), F.col("article_url")], limit,
        ["priority", "article_url", "pos"])
    return with_quota(ranked, sites)


def cascade(extracted: dict[str, DataFrame], sites: DataFrame) -> DataFrame:
    """Fill every site's quota from the extractors in ``METHODS`` order.

    ``extracted`` maps a method to its article records with ``pos``, the order within the site.
    """
    bound = largest_quota(sites)
    parts = []
    for priority, method in enumerate(METHODS):
        if method not in extracted:
            continue
        events = extracted[method]
        if method == METHODS[0]:
            events = read_ahead(events, sites, bound)
        parts.append(only_usable(events).withColumns({
            "method": F.lit(method), "priority": F.lit(priority)}))
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return fill_quota(united, sites, bound)


def site_summary(events: DataFrame, sites: DataFrame) -> DataFrame:
    """Extracted, usable and cut articles of every requested site, zero where nothing was found."""
    good = usable(F.col("content"), F.col("headline"))
    counts = events.withColumn("_good", good).groupBy("source_url").agg(
        F.count(F.lit(1)).alias("extracted"),
        F.count_if(F.col("_good")).alias("usable"),
        F.count_if(~F.col("_good")).alias("cut"),
    )
    requested = site_quotas(sites).withColumnRenamed("quota", "requested")
    zero = F.lit(0).cast("long")
    return requested.join(counts, "source_url", "left").select(
        "source_url", F.col("requested").cast("long").alias("requested"),
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("extracted", "usable", "cut")])


def method_totals(events: DataFrame) -> DataFrame:
    """How many articles each extractor contributed."""
    return events.groupBy("method").agg(F.count(F.lit(1)).alias("articles"))


def method_totals_by_site(events: DataFrame) -> DataFrame:
    """The same per site, with the totals as rows of their own."""
    return events.rollup("method", "source_url").agg(F.count(F.lit(1)).alias("articles"))


def grand_totals(summary: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return summary.agg(*[F.coalesce(F.sum(c), zero).alias(c)
                         for c in ("requested", "extracted", "usable", "cut")])
