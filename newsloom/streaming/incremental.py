"""Scheduled runs: each new file is processed once, known articles are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from newsloom.schemas import RAW_ARTICLE
from newsloom.sources.articles import from_files, with_seq
from newsloom.sources.tables import ArticleStore


def raw_stream(
    spark: SparkSession, folder: str, files_per_batch: int | None = None, lines: bool = False,
) -> DataFrame:
    """Raw-article files as they arrive in a folder, with the place of each row."""
    reader = spark.readStream.schema(RAW_ARTICLE).option("multiLine", not lines)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return from_files(reader.json(folder))


def ingest(
    stream: DataFrame, store: ArticleStore, checkpoint: str,
    process_batch: Callable[[DataFrame], DataFrame], date_mode: str = "lenient", **trigger,
) -> StreamingQuery:
    """Process each batch and append what the store does not have yet.

    A batch that is replayed after a failure finds its own rows stored and adds nothing, so the append
    is effectively once. ``process_batch`` maps raw rows with ``seq`` to processed rows.
    """
    def append(batch: DataFrame, _batch_id: int) -> None:
        store.insert(process_batch(with_seq(batch)), date_mode)

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
