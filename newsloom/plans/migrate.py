"""Loading processed-article files into the store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import store as S
from newsloom.session import shared_folder
from newsloom.sources.articles import read_processed
from newsloom.sources.tables import ArticleStore


def file_verdicts(checked: DataFrame) -> DataFrame:
    """Rows taken and refused per file; a file succeeds when none was refused."""
    good = F.size("violations") == 0
    return checked.groupBy("file").agg(
        F.count(F.lit(1)).alias("articles"),
        F.count_if(good).alias("inserted"),
        F.count_if(~good).alias("failed"),
    ).withColumn("success", F.col("failed") == 0)


def migrated_total(verdicts: DataFrame) -> DataFrame:
    """Only files without a refused row count."""
    return verdicts.agg(F.coalesce(
        F.sum(F.when(F.col("success"), F.col("articles"))), F.lit(0).cast("long")).alias("migrated"))


def migrate(
    spark: SparkSession, paths: Sequence[str], store: ArticleStore, date_mode: str = "strict",
    lines: bool = False,
) -> DataFrame:
    """Insert every valid row and return the verdict per file."""
    shared_folder(spark)  # checkpoints need a folder
    rows = read_processed(spark, paths, lines)
    # The verdict describes the store as it was, so it is settled before the insert.
    verdicts = file_verdicts(S.check(rows, store.articles(), date_mode)).checkpoint()
    store.insert(rows, date_mode)
    return verdicts
