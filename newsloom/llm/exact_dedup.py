"""Exact dedup as a stateful stream over arriving documents.

Arrivals (identifier, digest, row number) are landed once. A streaming aggregation keeps one entry per
digest in a disk-backed state store, without watermark, so nothing expires: the largest identifier, the
locator of its content (the row number of the arrival) and the number of copies. A digest that was seen
more than once is a hit. The full texts of all hits are then compared byte by byte, and texts that share a
digest but differ are told apart.

With a folder for the state, arrivals are landed there with their contents, and the stream goes on where the
call before it ended: documents of today meet those of all days before.

Scale: no text moves unless its digest is a hit. Texts of hits are combined within each task before the
shuffle, so a group of copies that holds a third of all rows sends one text per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import NO_ID, ascii_lower, or_blank, written
from newsloom.session import scratch_path
from newsloom.sources.folders import child_names

STORES = "spark.sql.streaming.internal.stateStore.partitions"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Bits of the filter of digests that were hit; with 24 it is a table of 512 rows and 2 MB at any size.
FILTER_BITS = 24
BITMAP_BITS = 32768
ARRIVALS = "ident long, digest binary, seq long"
CONTENTS = f"{ARRIVALS}, content string"


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def _ident(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("ident")


def _normal(text_col: str) -> Column:
    return ascii_lower(or_blank(F.col(text_col)))


def _locator() -> Column:
    """The row that stays: of the largest identifier, the one that came first."""
    return F.max_by("seq", F.struct(F.col("ident"), -F.col("seq"))).alias("locator")


def contents(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """``ident, content, digest`` of each row. The generator keeps Spark from repeating the digest of a whole
    text in every later expression and filter that mentions it."""
    both = F.transform(F.array(_normal(text_col)), lambda c: F.struct(
        c.alias("content"), digest(c).alias("digest")))
    return docs.select(_ident(id_col), F.inline(both))


def keyed_state(spark, arrivals: str, schema, files_per_batch: int | None = None,
                stores: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run the stream over the landed arrivals that it has not seen and read its state: one row per digest.

    ``stores`` is the number of state stores, by default two for each core. Every store keeps some files of
    a fixed size on disk, so their number follows the machines and not the shuffle partitions. A
    ``checkpoint`` that was used before keeps its entries and its number of stores.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    entries = reader.parquet(arrivals).groupBy("digest").agg(
        F.max("ident").alias("ident"), _locator(),
        F.count(F.lit(1)).alias("copies"))
    kept = checkpoint is not None
    checkpoint = checkpoint or scratch_path(spark, "dedup-state")
    wanted = {PROVIDER: ROCKS_DB, STORES: str(stores or 2 * spark.sparkContext.defaultParallelism)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        query = entries.writeStream.outputMode("update").format("noop").option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    query.awaitTermination()
    if not kept and not (query.lastProgress or {}).get("stateOperators"):
        return spark.createDataFrame([], "digest binary, ident long, locator long, copies long")
    state = spark.read.format("statestore").load(checkpoint)
    # The values are the buffers of the three aggregates, in their order.
    first, second, _, last = [f.name for f in state.schema["value"].dataType.fields]
    return state.select(
        "key.digest", F.col("value")[first].alias("ident"), F.col("value")[second].alias("locator"),
        F.col("value")[last].alias("copies"))


def _cell(digest: Column) -> Column:
    """The first bits of the digest as a number from 1."""
    head = F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")
    return F.shiftright(head, 32 - FILTER_BITS) + 1


def only_hits(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows whose digest may be among ``hits``: a bitmap of fixed size is joined by its block."""
    blocks = hits.select(_cell(F.col("digest")).alias("_cell")).groupBy(
        F.expr("bitmap_bucket_number(_cell)").alias("_block")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(_cell))").alias("_bits"))
    placed = rows.withColumn("_at", _cell(F.col("digest"))).withColumns({
        "_block": F.expr("bitmap_bucket_number(_at)"), "_bit": F.expr("bitmap_bit_position(_at)")})
    byte = F.conv(F.hex(F.expr("substring(_bits, int(_bit div 8) + 1, 1)")), 16, 10).cast("int")
    is_set = F.expr("shiftleft(1, int(_bit % 8))").bitwiseAND(byte) != 0
    return placed.join(F.broadcast(blocks), "_block").filter(is_set).select(*rows.columns)


def _per_text(rows: DataFrame, *more: Column) -> DataFrame:
    """One row per digest and full text; the grouping compares every byte."""
    return rows.groupBy("digest", "content").agg(
        F.max("ident").alias("keep"), F.count(F.lit(1)).alias("copies"), *more)


def _landed(docs: DataFrame, id_col: str, text_col: str, digest, folder: str) -> int:
    """Append the rows with their contents to ``folder``; the first of their numbers, above all that are there."""
    spark = docs.sparkSession
    start = 0
    if child_names(spark, folder):
        start = (spark.read.schema("seq long").parquet(folder).agg(F.max("seq")).first()[0] or 0) + 1
    rows = contents(docs, id_col, text_col, digest).select(
        "ident", "digest", (F.monotonically_increasing_id() + start).alias("seq"), "content")
    rows.write.mode("append").option("compression", "zstd").parquet(folder)
    return start


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest=sha256, files_per_batch: int | None = None, state: str | None = None) -> DataFrame:
    """Every row of ``docs`` with the identifier that stays of its group of equal texts.

    Texts are equal when identical after lower-casing A-Z. Returns ``doc_id, keep_id, group_size, kept,
    digest``. Null text counts as empty. A null identifier sorts below all others; a group of nothing else
    has ``keep_id`` null. Of rows repeated with the same identifier and text the one that came first is kept. An empty
    table gives an empty result. Other columns of ``docs`` are not read, whatever their names.

    ``digest`` makes the state key from a text. A weak one costs time and never joins different texts.
    ``files_per_batch`` bounds the landed files of one micro-batch.

    ``state`` is a folder that all executors share. Calls with one folder see the rows of all calls before:
    groups, sizes and the largest identifier are taken over all of them, and rows of ``docs`` alone are
    returned. A row that an earlier call kept is superseded when a later one brings its text with a larger
    identifier. The folder keeps every text, and contents are read again at the places of hits alone: files
    and row groups below the first of these places are passed over. One call at a time; every call has the
    same ``digest``. Rows count from the moment they are landed, also if the call then fails.
    """
    spark = docs.sparkSession
    if state is None:
        start, landed = 0, scratch_path(spark, "dedup-arrivals")
        rows = contents(docs, id_col, text_col, digest)
        docs.select(
            _ident(id_col), digest(_normal(text_col)).alias("digest"),
            F.monotonically_increasing_id().alias("seq")).write.parquet(landed)
    else:
        landed = f"{state.rstrip('/')}/arrivals"
        start = _landed(docs, id_col, text_col, digest, landed)
        rows = spark.read.schema(CONTENTS).parquet(landed)
    every = spark.read.schema(ARRIVALS).parquet(landed)
    arrivals = every.filter(F.col("seq") >= start) if start else every
    entries = keyed_state(spark, landed, every.schema, files_per_batch, checkpoint=state and f"{state.rstrip('/')}/stream")
    hits = entries.filter("copies > 1")
    if start:
        hits = hits.join(arrivals.select("digest"), "digest", "left_semi")
    hits = written(hits, "dedup-hits")
    if start:
        first = every.join(hits.select("digest"), "digest", "left_semi").agg(F.min("seq")).first()[0]
        rows = rows.filter(F.col("seq") >= (start if first is None else first))
    # Grouping the full bytes of all hits tells whether one text or several stand behind a digest.
    texts = _per_text(only_hits(rows, hits)).join(hits.select("digest"), "digest")
    differing = written(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter(
        "texts > 1").select("digest"), "dedup-differing")
    found = arrivals.join(hits.select(
        "digest", F.col("ident").alias("keep"), "locator", "copies"), "digest", "left").select(
        "ident", F.coalesce("keep", "ident").alias("keep"), F.coalesce("copies", F.lit(1)).alias("copies"),
        (F.coalesce("locator", "seq") == F.col("seq")).alias("kept"), "digest")
    if not differing.isEmpty():
        found = found.join(differing, "digest", "left_anti").unionByName(_apart(rows, differing, start))
    return found.select(
        F.nullif("ident", F.lit(NO_ID)).alias("doc_id"), F.nullif("keep", F.lit(NO_ID)).alias("keep_id"),
        F.col("copies").alias("group_size"), "kept", "digest")


def _apart(rows: DataFrame, differing: DataFrame, start: int) -> DataFrame:
    """Rows from number ``start`` on whose digest stands for several texts, grouped by their texts instead."""
    shared = rows.join(differing, "digest", "left_semi")
    placed = shared if "seq" in rows.columns else shared.withColumn("seq", F.monotonically_increasing_id())
    numbered = written(placed, "dedup-shared")
    groups = _per_text(numbered, _locator())
    return numbered.filter(F.col("seq") >= start).join(groups, ["digest", "content"]).select(
        "ident", "keep", "copies", (F.col("locator") == F.col("seq")).alias("kept"), "digest")
