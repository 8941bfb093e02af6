"""The article store: constraints, lookups and changes as DataFrame functions.

``articles`` has one row per ``content_hash``; ``factors`` has ``content_hash, pos, factor_name``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import dates as D
from newsloom.functions.text import preview
from newsloom.schemas import (
    FACTOR_LIMIT, HASH_LIMIT, RELEVANCE, SENTIMENTS, STATUSES, STORED_ARTICLE,
)
from newsloom.sources.landing import landed

REQUIRED = ("content_hash", "headline", "sentiment", "summary", "relevant", "processing_status")


def store_date(text: Column, date_mode: str = "strict") -> Column:
    return D.strict_date(text) if date_mode == "strict" else D.lenient_date(text)


def _column(df: DataFrame, name: str, kind: T.DataType) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def store_columns(
    processed: DataFrame, date_mode: str = "strict", now: Column | None = None,
) -> list[Column]:
    """The store's columns as expressions; a column the input lacks becomes NULL."""
    stamp = F.current_timestamp() if now is None else now
    fields = []
    for field in STORED_ARTICLE.fields:
        if field.name in ("created_at", "updated_at"):
            value = stamp
        elif field.name == "date":
            value = store_date(_column(processed, "date", T.StringType()), date_mode)
        else:
            value = _column(processed, field.name, field.dataType)
        fields.append(value.alias(field.name))
    return fields


def to_store_rows(
    processed: DataFrame, date_mode: str = "strict", now: Column | None = None,
) -> DataFrame:
    """Project processed articles to the rows of the ``articles`` table."""
    return processed.select(*store_columns(processed, date_mode, now))


def factor_rows(processed: DataFrame) -> DataFrame:
    """One child row per quality factor."""
    return processed.select(
        "content_hash", F.posexplode("quality_factors").alias("pos", "factor_name"))


def own_violations(processed: DataFrame, date_mode: str = "strict") -> Column:
    """Names of the constraints a row breaks by itself."""
    def closed_set(name: str, values: tuple[str, ...]) -> Column:
        return F.when(~F.col(name).isin(*values), f"{name}_unknown")

    rules = [F.when(F.col(name).isNull(), f"{name}_missing") for name in REQUIRED]
    rules += [
        F.when(F.length("content_hash") > HASH_LIMIT, "content_hash_too_long"),
        closed_set("sentiment", SENTIMENTS),
        closed_set("relevant", RELEVANCE),
        closed_set("processing_status", STATUSES),
    ]
    if "quality_factors" in processed.columns:
        too_long = F.exists("quality_factors", lambda f: F.length(f) > FACTOR_LIMIT)
        missing = F.exists("quality_factors", lambda f: f.isNull())
        rules += [F.when(too_long, "factor_too_long"), F.when(missing, "factor_missing")]
    if date_mode == "strict" and "date" in processed.columns:
        bad = F.col("date").isNotNull() & store_date(F.col("date"), date_mode).isNull()
        rules.append(F.when(bad, "date_invalid"))
    return F.array_compact(F.array(*rules))


def verdicts(batch: DataFrame, stored: DataFrame | None = None, date_mode: str = "strict") -> DataFrame:
    """``seq, content_hash, violations`` of every row of a batch in insertion order ``seq``.

    The batch is read once; the narrow rows that come of it are landed. The first row of a hash that is valid by
    itself and not stored yet takes the hash. Winners are found by a hash aggregate and joined back on the unique
    ``seq``, so one hash with a third of the batch never meets in one task.
    """
    rows = landed(batch.select("seq", "content_hash", own_violations(batch, date_mode).alias("_own")), "judged")
    first = winners(rows.filter(F.size("_own") == 0), stored).select("seq", F.lit(True).alias("_winner"))
    taken = (F.size("_own") == 0) & F.col("_winner").isNull()
    return rows.join(first, "seq", "left").select("seq", "content_hash", F.when(
        taken, F.array(F.lit("content_hash_taken"))).otherwise(F.col("_own")).alias("violations"))


def winners(valid: DataFrame, stored: DataFrame | None) -> DataFrame:
    """``content_hash, seq``: the first of the valid rows of every hash that is not stored."""
    firsts = valid.groupBy("content_hash").agg(F.min("seq").alias("seq"))
    return firsts if stored is None else firsts.join(stored.select("content_hash"), "content_hash", "left_anti")


def check(batch: DataFrame, stored: DataFrame | None = None, date_mode: str = "strict") -> DataFrame:
    """The batch with ``violations`` of every row; see ``verdicts``."""
    return batch.join(verdicts(batch, stored, date_mode).select("seq", "violations"), "seq").select(*batch.columns, "violations")


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violations") == 0).drop("violations")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violations") > 0)


def insertable(batch: DataFrame, stored: DataFrame | None = None, date_mode: str = "strict") -> DataFrame:
    """Just the rows an insert would take, without the verdicts of the others. Numbers of winners are found among
    landed hashes and joined to the batch."""
    valid = F.size(own_violations(batch, date_mode)) == 0
    rows = landed(batch.filter(valid).select("content_hash", "seq"), "valid")
    return batch.join(winners(rows, stored).select("seq"), "seq", "left_semi").select(*batch.columns)


def batch_counts(checked: DataFrame) -> DataFrame:
    """Inserted and failed rows of a batch."""
    good = F.size("violations") == 0
    return checked.agg(F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"))


def only_new(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose hash is not stored."""
    return batch.join(stored.select("content_hash"), "content_hash", "left_anti").select(*batch.columns)


def only_known(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose hash is stored."""
    return batch.join(stored.select("content_hash"), "content_hash", "left_semi").select(*batch.columns)


# --- queries --------------------------------------------------------------------------------

def factor_lists(factors: DataFrame) -> DataFrame:
    """The factors of each article as an array in stored order; a handful per article."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "factor_name")))
    return factors.groupBy("content_hash").agg(ordered.alias("_f")).select(
        "content_hash", F.transform("_f", lambda f: f["factor_name"]).alias("quality_factors"))


def with_factors(articles: DataFrame, factors: DataFrame) -> DataFrame:
    """Articles with their factor list, an empty one where there is none."""
    lists = factor_lists(factors)
    return articles.join(lists, "content_hash", "left").withColumn(
        "quality_factors",
        F.coalesce(F.col("quality_factors"), F.array().cast("array<string>")))


def by_hash(articles: DataFrame, factors: DataFrame, content_hash: str) -> DataFrame:
    """One article with its factors, NULL where there are none. The condition reaches both scans."""
    wanted = F.col("content_hash") == content_hash
    return articles.filter(wanted).join(
        factor_lists(factors.filter(wanted)), "content_hash", "left")


def by_date_range(articles: DataFrame, factors: DataFrame, start: str, end: str) -> DataFrame:
    """Articles of the days from ``start`` to ``end``, both included, newest day first."""
    days = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return with_factors(articles.filter(days), factors).orderBy(F.desc("date"), "content_hash")


def newest(articles: DataFrame, limit: int = 10) -> DataFrame:
    return articles.orderBy(F.desc("created_at"), "content_hash").limit(limit)


def recent(articles: DataFrame, factors: DataFrame, limit: int = 10) -> DataFrame:
    """The most recently stored articles. Factors are read only for those rows."""
    top = newest(articles, limit)
    few = factors.join(top.select("content_hash"), "content_hash", "left_semi")
    return with_factors(top, few).orderBy(F.desc("created_at"), "content_hash")


def find(articles: DataFrame, where: Column) -> DataFrame:
    """Any condition over the store's columns; status prunes folders, the others prune row groups."""
    return articles.filter(where)


def count_rows(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count(F.lit(1)).alias("article_count"))


def status_lines(articles: DataFrame, limit: int = 5, width: int = 40) -> DataFrame:
    """The newest articles as printable lines next to the total count."""
    total = count_rows(articles)
    line = F.format_string(
        "[%s] %s... (Q:%s)",
        F.coalesce(F.col("date").cast("string"), F.lit("None")),
        preview(F.col("headline"), width),
        F.coalesce(F.col("quality_score").cast("string"), F.lit("None")))
    rows = newest(articles, limit).select("content_hash", "created_at", line.alias("line"))
    # Both sides are bounded: one row, and ``limit`` rows.
    return rows.join(F.broadcast(total), F.lit(True), "left").orderBy(
        F.desc("created_at"), "content_hash")


# --- changes --------------------------------------------------------------------------------

def delete_by_hash(
    articles: DataFrame, factors: DataFrame, hashes: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given hashes; child rows go with their article."""
    return (
        articles.join(hashes.select("content_hash"), "content_hash", "left_anti").select(*articles.columns),
        factors.join(hashes.select("content_hash"), "content_hash", "left_anti").select(*factors.columns),
    )


def deletion_report(articles: DataFrame, hashes: DataFrame) -> DataFrame:
    """For each requested hash, whether an article was there to delete."""
    known = articles.select("content_hash", F.lit(True).alias("deleted"))
    return hashes.select("content_hash").distinct().join(known, "content_hash", "left").select(
        "content_hash", F.coalesce(F.col("deleted"), F.lit(False)).alias("deleted"))


def upsert(articles: DataFrame, changes: DataFrame, now: datetime | Column | None = None) -> DataFrame:
    """Replace or add rows by hash; changed rows keep ``created_at`` and get a new ``updated_at``."""
    stamp = F.current_timestamp() if now is None else (now if isinstance(now, Column) else F.lit(now))
    previous = articles.select("content_hash", F.col("created_at").alias("_created"))
    touched = changes.join(previous, "content_hash", "left").withColumns({
        "created_at": F.coalesce(F.col("_created"), stamp), "updated_at": stamp}).drop("_created")
    untouched = articles.join(changes.select("content_hash"), "content_hash", "left_anti")
    return untouched.select(*articles.columns).unionByName(touched.select(*articles.columns))
