"""Row types of the article data model."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


def _ints(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.IntegerType()) for name in names]


RAW_ARTICLE = T.StructType(_strings("date", "headline", "content", "article_url", "source_url"))

METRIC_COLUMNS = ("content_length", "sentence_count", "tech_keyword_count", "quality_score")
ANNOTATION_COLUMNS = ("sentiment", "summary", "relevant", "processing_status")

PROCESSED_ARTICLE = T.StructType(
    _strings("date", "headline", "article_url", "source_url", "content_hash")
    + _ints("quality_score")
    + [T.StructField("quality_factors", T.ArrayType(T.StringType()))]
    + _ints("content_length", "sentence_count", "tech_keyword_count")
    + _strings(*ANNOTATION_COLUMNS)
)

STORED_ARTICLE = T.StructType(
    _strings("content_hash", "headline")
    + [T.StructField("date", T.DateType())]
    + _strings("article_url", "source_url")
    + _ints("content_length", "sentence_count", "tech_keyword_count", "quality_score")
    + _strings(*ANNOTATION_COLUMNS)
    + [
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

STORED_FACTOR = T.StructType(
    _strings("content_hash") + _ints("pos") + _strings("factor_name")
)

SITE = T.StructType(_strings("source_url") + _ints("quota"))
PAGE = T.StructType(_strings("url", "html"))
SEARCH_PAGE = T.StructType(_strings("query") + _ints("page", "status") + _strings("body"))
RESPONSE = T.StructType(
    [T.StructField("seq", T.LongType())] + _ints("attempt", "status") + _strings("body")
)

# The closed value sets of the store.
SENTIMENTS = ("利好", "中立", "利弊")
RELEVANCE = ("是", "否")
STATUSES = ("success", "failed", "low_quality", "no_content", "error")
HASH_LIMIT = 32
FACTOR_LIMIT = 50
REQUIRED_TABLES = ("articles", "quality_factors")
