"""Rule-based quality metrics, one projection over the text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.binding import settled
from newsloom.functions.text import or_empty, sentence_count, strip
from newsloom.profiles import Band, Profile


def _band(value: Column, bands: Sequence[Band], pick: int) -> Column:
    """Points (``pick`` 1) or label (``pick`` 2) of the first band the value reaches."""
    *better, floor = bands
    chosen = F
    for band in better:
        chosen = chosen.when(value >= band[0], F.lit(band[pick]))
    return chosen.otherwise(F.lit(floor[pick])) if better else F.lit(floor[pick])


def keyword_count(content: Column, keywords: Sequence[str], casefold: bool = False) -> Column:
    """How many listed keywords occur in the lower-cased text.

    A keyword with a capital letter cannot occur in lower-cased text; it is left out of the plan
    unless ``casefold`` lowers the list as well.
    """
    words = [k.lower() if casefold else k for k in keywords]
    lowered = F.lower(content)
    hits = [F.contains(lowered, F.lit(k)).cast("int") for k in words if k == k.lower()]
    return sum(hits, F.lit(0))


def quality_level(score: Column) -> Column:
    return F.when(score >= 7, "high").when(score >= 4, "medium").otherwise("poor")


def measure(
    articles: DataFrame, profile: Profile, keywords: Sequence[str] | None = None,
    casefold_keywords: bool = False,
) -> DataFrame:
    """Add the three counts the bands are read from; the only step that touches the text."""
    content = or_empty(F.col("content"))
    words = profile.keywords if keywords is None else keywords
    counts = {
        "content_length": F.length(content),
        "sentence_count": sentence_count(content),
        "tech_keyword_count": keyword_count(content, words, casefold_keywords),
    }
    return settled(articles.withColumns(counts), *counts)


def grade(measured: DataFrame, profile: Profile) -> DataFrame:
    """Add ``quality_score`` and ``quality_factors`` to measured rows."""
    banded = [
        (F.col("content_length"), profile.length_bands),
        (F.col("sentence_count"), profile.sentence_bands),
        (F.col("tech_keyword_count"), profile.keyword_bands),
    ]
    if profile.headline_bands:
        banded.append((F.length(or_empty(F.col("headline"))), profile.headline_bands))
    points = [_band(value, bands, 1) for value, bands in banded]
    labels = [_band(value, bands, 2) for value, bands in banded]
    if profile.metadata_points:
        for column, label in (("date", "has_date"), ("article_url", "has_url")):
            present = or_empty(F.col(column)) != ""
            points.append(present.cast("int"))
            labels.append(F.when(present, label))
    return measured.withColumns({
        "quality_score": sum(points[1:], points[0]),
        "quality_factors": F.array_compact(F.array(*labels)),
    })


def assess(
    articles: DataFrame, profile: Profile, keywords: Sequence[str] | None = None,
    casefold_keywords: bool = False,
) -> DataFrame:
    """All metrics of an article."""
    return grade(measure(articles, profile, keywords, casefold_keywords), profile)


def with_flags(articles: DataFrame) -> DataFrame:
    """Presence flags of the in-memory metrics record."""
    return articles.withColumns({
        "has_date": or_empty(F.col("date")) != "",
        "has_url": or_empty(F.col("article_url")) != "",
    })


def passes_gate(profile: Profile) -> Column:
    return F.col("quality_score") >= F.lit(profile.gate)


def usable(content: Column, headline: Column, minimum: int = 200) -> Column:
    """Text long enough after stripping, and a headline that is not blank; missing values fail."""
    return F.coalesce(
        (F.length(strip(content)) >= minimum) & (F.length(strip(headline)) > 0), F.lit(False))
