"""From raw articles to processed articles and run statistics.

The text is read once, in the scan stage, where the hash and all counts are computed. These narrow rows
are landed; the first row of each hash is found among them and joined by number. Article bodies are neither
sorted, aggregated nor shuffled. The price is that duplicates are measured too. A scorer's texts are read
after that, those of the articles that need a score alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.hashing import content_hash
from newsloom.functions.text import or_empty
from newsloom.operators import annotate as N
from newsloom.operators import dedup as D
from newsloom.operators import quality as Q
from newsloom.profiles import Profile
from newsloom.sources.landing import landed

NARROW = ("date", "headline", "article_url", "source_url")
METRICS = ("content_length", "sentence_count", "tech_keyword_count", "quality_score", "quality_factors")
RESULT = ("sentiment", "summary", "relevant", "processing_status")


def measured(
    articles: DataFrame, profile: Profile, keywords: Sequence[str] | None = None, null_is_error: bool = False,
    columns: Sequence[str] = (*NARROW, *METRICS),
) -> DataFrame:
    """``columns`` with the hash of every article, landed; the hash is NULL without content that the profile discards."""
    content = F.col("content")
    flag = content != "" if null_is_error else or_empty(content) != ""
    text = F.coalesce(content, F.lit("None" if null_is_error else ""))
    identity = content_hash(F.col("headline"), text, profile)
    if profile.drops_empty_content:
        identity = F.when(flag, identity)
    rows = Q.assess(articles, profile, keywords).withColumns({"has_content": flag, "content_hash": identity})
    return landed(rows.select("seq", "content_hash", "has_content", *columns), "measured")


def groups_of(narrow: DataFrame) -> DataFrame:
    """One row per content hash, NULL being one, with the first article's columns and the number of ``copies``."""
    return narrow.join(D.first_rows(narrow, "content_hash"), "seq")


def _output(routed: DataFrame, profile: Profile) -> DataFrame:
    identity = ["content_hash"] if profile.keeps_hash else []
    return routed.filter(F.col("content_hash").isNotNull()).select(
        "seq", *NARROW, *identity, *METRICS, *RESULT)


def process(
    articles: DataFrame, responses: DataFrame, profile: Profile,
    keywords: Sequence[str] | None = None, null_is_error: bool = False,
) -> DataFrame:
    """Processed articles: unique, scored, annotated from the table of replies, with a status."""
    return annotated(measured(articles, profile, keywords, null_is_error), responses, profile, null_is_error)


def annotated(narrow: DataFrame, responses: DataFrame, profile: Profile, null_is_error: bool = False) -> DataFrame:
    """The same from ``measured`` rows, whose ``seq`` may have been changed since: by it the first of equal articles is
    found, and replies."""
    return _output(_routed(narrow, responses, profile, null_is_error), profile)


def _routed(narrow, responses, profile, null_is_error):
    joined = N.attach(groups_of(narrow), N.replies(responses, profile))
    return N.route(joined, profile, null_is_error)


def process_with_scorer(
    articles: DataFrame, scorer: Callable[[pd.Series], pd.DataFrame], profile: Profile,
    keywords: Sequence[str] | None = None, concurrency: int | None = None,
) -> DataFrame:
    """The same with a scorer function in place of stored replies."""
    narrow = measured(articles, profile, keywords)
    groups = groups_of(narrow)
    wanted = groups.filter(F.col("content_hash").isNotNull() & F.col("has_content") & Q.passes_gate(profile))
    # Texts meet the numbers of those that need no score; these are the fewer, and Spark broadcasts them if they are few.
    unscored = narrow.select("seq").join(wanted.select("seq"), "seq", "left_anti")
    texts = articles.select("seq", "content").join(unscored, "seq", "left_anti")
    outcomes = N.scored(texts, scorer, profile, concurrency)
    return _output(N.route(N.attach(groups, outcomes), profile), profile)


def summary_of(processed: DataFrame) -> DataFrame:
    """Statistics over processed articles alone."""
    return processed.agg(*_statistics(F.lit(True)))


def _statistics(real):
    def count_where(condition):
        return F.count_if(real & condition)

    status = F.col("processing_status")
    score = F.coalesce(F.col("quality_score"), F.lit(0))
    return [
        F.count_if(real).alias("unique_count"),
        count_where(status == "success").alias("success_count"),
        count_where(status == "failed").alias("failed_count"),
        count_where(status == "low_quality").alias("low_quality_count"),
        count_where(F.col("relevant") == "是").alias("relevant_count"),
        F.coalesce(F.avg(F.when(real, score)), F.lit(0.0)).alias("avg_quality"),
    ]


def run_summary(
    articles: DataFrame, responses: DataFrame, profile: Profile,
    keywords: Sequence[str] | None = None, null_is_error: bool = False,
) -> DataFrame:
    """Statistics of a run in one row, from the same single pass over the text."""
    narrow = measured(articles, profile, keywords, null_is_error, ("quality_score",))
    routed = _routed(narrow, responses, profile, null_is_error)
    real = F.col("content_hash").isNotNull()
    copies = F.col("copies")
    zero = F.lit(0).cast("long")
    return routed.agg(
        F.coalesce(F.sum(copies), zero).alias("loaded"),
        F.coalesce(F.sum(F.when(~real, copies)), zero).alias("empty_dropped"),
        F.coalesce(F.sum(F.when(real, copies - 1)), zero).alias("duplicate_count"),
        *_statistics(real),
    )
