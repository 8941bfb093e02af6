"""Narrow rows written to the shared folder, so that several branches read them and not the text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from newsloom.session import scratch_path


def landed(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` computed once, written and read back; later plans start from these files."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
