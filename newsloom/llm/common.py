"""Helpers shared by the operators: text definitions and tables in the shared folder."""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import scratch_path

# Fixed value: a word is a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
PLAN_CHARS = "spark.sql.maxPlanStringLength"
# Stands for a missing identifier where identifiers are compared; sorts below all others.
NO_ID = -(2 ** 63)


def or_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared folder and read back: computed once, lineage cut, and safe when an
    executor is lost. Compressed well, as texts may be among its columns."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_batches(frame: DataFrame) -> DataFrame:
    """``frame`` after limiting Arrow batches of its session by bytes, so that long texts do not pile up in a
    Python worker. A limit that the session already has is left alone."""
    conf = frame.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:
        conf.set(BATCH_BYTES, str(4 << 20))
    return frame


def short_plans(frame: DataFrame) -> DataFrame:
    """``frame`` after limiting the printed plans of its session. The driver keeps the text of every plan it ran, and
    a literal table in a plan is printed whole, each time. A limit that the session already has is left alone."""
    conf = frame.sparkSession.conf
    if conf.get(PLAN_CHARS, None) is None:
        conf.set(PLAN_CHARS, str(1 << 16))
    return frame


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of the highest counts ``n``, at most ``most`` of them: counts fall into eight levels to each doubling,
    and the levels are taken from the top while all of their words fit."""
    levelled = counts.withColumn("level", F.floor(F.log2("n") * 8))
    sizes = sorted(((r[0], r[1]) for r in levelled.groupBy("level").count().collect()), reverse=True)
    lowest, taken = None, 0
    for level, size in sizes:
        if taken + size > most:
            break
        lowest, taken = level, taken + size
    return levelled.filter(F.lit(False) if lowest is None else F.col("level") >= lowest).drop("level")


def arrow_bytes(bounded: DataFrame) -> bytes:
    """A table of proven size in Arrow's stream format, to be broadcast."""
    rows = bounded.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()
