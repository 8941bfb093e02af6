"""Exact duplicate removal: the first row of every content hash stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.hashing import content_hash
from newsloom.functions.text import or_empty, preview
from newsloom.profiles import Profile
from newsloom.sources.landing import landed


def hashed(articles: DataFrame, profile: Profile) -> DataFrame:
    """Add the content hash of the profile."""
    return articles.withColumn(
        "content_hash", content_hash(F.col("headline"), or_empty(F.col("content")), profile))


def drop_empty_content(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("content") != "")


def first_rows(narrow: DataFrame, key: str) -> DataFrame:
    """``seq, copies``: the lowest ``seq`` of every key and the size of its group, NULL being a key too.

    Both are combined before the shuffle, in a hash aggregate over two numbers: a key that holds a third of all
    rows sends one row per task. ``dropDuplicates`` would keep an arbitrary row.
    """
    return narrow.groupBy(key).agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("copies")).drop(key)


def later_rows(narrow: DataFrame, key: str) -> DataFrame:
    """The ``seq`` of rows that have an earlier one of the same key; a NULL key has no duplicates. Only keys that
    occur more than once are joined, and a hot one is split, as both sides of the join are plain reads."""
    firsts = narrow.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_same")).agg(
        F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    return narrow.join(firsts, F.col(key) == F.col("_same")).filter(F.col("seq") > F.col("_first")).select("seq")


def _narrow(articles: DataFrame, profile: Profile, carried: dict[str, Column]) -> DataFrame:
    """``seq, content_hash`` and what else is asked for of every article the profile looks at, landed: here the text
    is read and hashed, once."""
    rows = drop_empty_content(articles) if profile.drops_empty_content else articles
    return landed(hashed(rows, profile).select(
        "seq", "content_hash", *[value.alias(name) for name, value in carried.items()]), "hashed")


def unique_rows(articles: DataFrame, profile: Profile, **carried: Column) -> DataFrame:
    """``seq, content_hash`` of the unique articles with ``carried`` values, which may be computed from the text: one
    pass over it, whatever is asked for."""
    narrow = _narrow(articles, profile, carried)
    return narrow.join(later_rows(narrow, "content_hash"), "seq", "left_anti")


def deduplicate(articles: DataFrame, profile: Profile) -> DataFrame:
    """Unique articles with their bodies. Profile A also discards rows without content and keeps the hash column.

    A body is read twice, for its hash and for the result, and never moves: it only meets the numbers of the
    losing rows, which Spark broadcasts if they are few. Without need of bodies, take ``unique_rows``.
    """
    losers = later_rows(_narrow(articles, profile, {}), "content_hash")
    rows = drop_empty_content(articles) if profile.drops_empty_content else articles
    unique = rows.join(losers, "seq", "left_anti").select(*articles.columns)
    return hashed(unique, profile) if profile.keeps_hash else unique


def unique_rows_by(articles: DataFrame, key: Column, **carried: Column) -> DataFrame:
    """``seq`` and ``carried`` values of unique articles by any other key, for example URL or title. Without a key, NULL
    or empty, an article is nobody's duplicate and stays."""
    named = {"_key": F.nullif(key, F.lit("")), **carried}
    narrow = landed(articles.select("seq", *[value.alias(name) for name, value in named.items()]), "keyed")
    return narrow.join(later_rows(narrow, "_key"), "seq", "left_anti").drop("_key")


def deduplicate_by(articles: DataFrame, key: Column) -> DataFrame:
    """The same with all columns of the articles."""
    narrow = landed(articles.select("seq", F.nullif(key, F.lit("")).alias("_key")), "keyed")
    return articles.join(later_rows(narrow, "_key"), "seq", "left_anti").select(*articles.columns)


def duplicate_counts(articles: DataFrame, profile: Profile) -> DataFrame:
    """Rows loaded, without content (profile A), unique and duplicate, in one row."""
    keyed = hashed(articles, profile).select(
        F.when(F.lit(not profile.drops_empty_content) | (or_empty(F.col("content")) != ""),
               F.col("content_hash")).alias("content_hash"))
    groups = keyed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"))
    real = F.col("content_hash").isNotNull()
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("loaded"),
        F.coalesce(F.sum(F.when(~real, F.col("copies"))), F.lit(0)).alias("empty_dropped"),
        F.count_if(real).alias("unique_count"),
        F.coalesce(F.sum(F.when(real, F.col("copies") - 1)), F.lit(0)).alias("duplicate_count"),
    )


def duplicate_report(articles: DataFrame, profile: Profile) -> DataFrame:
    """Every removed row with the start of its headline, in one pass over the text. No task ever holds one hash's
    whole group."""
    narrow = _narrow(articles, profile, {"headline_start": preview(F.col("headline"), 50)})
    return narrow.join(later_rows(narrow, "content_hash"), "seq", "left_semi")
