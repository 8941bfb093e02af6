"""Article files in and out.

A file is either one JSON array or, with ``lines``, one JSON object per line. Spark splits the latter
over tasks; an array is read by one task, however large, so convert big archives once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import preview
from newsloom.schemas import PROCESSED_ARTICLE, RAW_ARTICLE
from newsloom.session import scratch_path
from newsloom.sources.folders import next_number


def _json_files(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, mode: str, lines: bool,
) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", not lines).option("mode", mode)
    return reader.json(paths if isinstance(paths, str) else list(paths))


PLACE = ("_file", "_block")


def from_files(df: DataFrame) -> DataFrame:
    """Adds the file and the block that each row comes from."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def with_seq(df: DataFrame) -> DataFrame:
    """Rows of files (``from_files``) with ``seq``, their position in the order of paths and of rows within a
    file, from 0.

    The rows are written to the shared folder once, with the block of the file that each comes from, and
    come back numbered: the numbers are the same however Spark cuts files into tasks, and later scans read
    what was written. Only one number per block is ordered in one task. A table that does not come from
    files has no such order; its rows get increasing numbers for the life of the plan.
    """
    if "_file" not in df.columns:
        return df.withColumn("seq", F.monotonically_increasing_id())
    spark = df.sparkSession
    path = scratch_path(spark, "numbered")
    df.withColumn("_row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    landed = spark.read.parquet(path)
    blocks = landed.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(
        Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))
    placed = blocks.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_rows")
    # One row for each block. Spark takes its table for as large as the texts, and would shuffle these for the join.
    return landed.join(F.broadcast(placed), ["_file", "_block"]).select(
        *[c for c in df.columns if c not in PLACE], (F.col("_before") + F.col("_row") - F.col("_first")).alias("seq"))


def read_raw(spark: SparkSession, path: str, strict: bool = True, lines: bool = False) -> DataFrame:
    """Raw articles with ``seq``. Strict: a missing or broken file is an error. Otherwise a missing
    file, a broken array or a broken line has no rows."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    try:
        return with_seq(from_files(_json_files(spark, path, RAW_ARTICLE, mode, lines)))
    except AnalysisException as problem:
        if strict or problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType([*RAW_ARTICLE, T.StructField("seq", T.LongType())]))


def read_processed(
    spark: SparkSession, paths: str | Sequence[str], lines: bool = False,
) -> DataFrame:
    """Processed articles with ``seq`` and the ``file`` they come from."""
    rows = _json_files(spark, paths, PROCESSED_ARTICLE, "FAILFAST", lines)
    return with_seq(from_files(rows).withColumn("file", F.col("_file")))


def write_processed(processed: DataFrame, path: str, fmt: str = "json") -> None:
    """One JSON object per line, non-ASCII as it is, or Parquet."""
    columns = [f.name for f in PROCESSED_ARTICLE.fields if f.name in processed.columns]
    processed.select(*columns).write.mode("error").format(fmt).save(path)


def append_numbered(articles: DataFrame, root: str) -> int:
    """Add a crawl result under the next free run number; earlier runs are never touched."""
    run = next_number(articles.sparkSession, root, "run_id=")
    articles.write.mode("error").parquet(f"{root}/run_id={run}")
    return run


def read_numbered(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def timestamped_path(spark: SparkSession, root: str, name: str) -> str:
    """``<root>/<name>_<yyyyMMdd_HHmmss>``, with a counter if that exists."""
    from newsloom.sources.folders import child_names

    stamp = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0]
    taken = set(child_names(spark, root))
    candidate, counter = f"{name}_{stamp}", 0
    while candidate in taken:
        counter += 1
        candidate = f"{name}_{stamp}_{counter}"
    return f"{root}/{candidate}"


def sample_headlines(articles: DataFrame, count: int = 1, width: int = 60) -> DataFrame:
    """The first rows by ``seq`` with the start of their headline."""
    return articles.orderBy("seq").limit(count).select(
        "seq", preview(F.col("headline"), width).alias("headline_start"))


def rows_per_file(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("articles"))
