"""The article store as a Parquet table laid out by hash.

An article row carries its factors as an array and ``quality_factors`` is derived from it: an append
is one atomic write and an article can never lose its children. Rows lie in buckets by hash, and by status
within them, with a Bloom filter for the hash in every row group. A lookup by hash opens one bucket and there the row
groups that may hold it; changes other than appends overwrite the folders that hold changed rows, and no other file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators import store as S
from newsloom.schemas import REQUIRED_TABLES, STORED_ARTICLE
from newsloom.sources.folders import child_names, remove
from newsloom.sources.landing import landed

LAYOUT = T.StructType(
    [*STORED_ARTICLE.fields, T.StructField("quality_factors", T.ArrayType(T.StringType()))])
PARTS = ("bucket", "processing_status")
# Buckets of a new store. Choose as many as keep a bucket small enough to be rewritten for one changed row.
BUCKETS = 16
BLOOM = {
    "parquet.bloom.filter.enabled#content_hash": "true", "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.enable.dictionary#content_hash": "false"}


class ArticleStore:
    """One writer at a time. A reader that runs during a delete or an upsert may see folders of before and after."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        """``buckets`` must be what the store was made with."""
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _bucket(self, content_hash: Column) -> Column:
        return F.pmod(F.xxhash64(content_hash), F.lit(self.buckets)).cast("int")

    def _table(self) -> DataFrame:
        """All rows with their ``bucket``."""
        schema = T.StructType([*LAYOUT.fields, T.StructField("bucket", T.IntegerType())])
        if not any("=" in name for name in child_names(self.spark, self.root)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.root)

    def rows(self) -> DataFrame:
        return self._table().select(*LAYOUT.names)

    def articles(self) -> DataFrame:
        return self.rows().drop("quality_factors")

    def factors(self) -> DataFrame:
        return S.factor_rows(self.rows())

    def get(self, content_hash: str) -> DataFrame:
        """The article of a hash with its factors. Only its bucket is opened, and there the row groups that may hold it."""
        wanted = F.lit(content_hash)
        return self._table().filter((F.col("bucket") == self._bucket(wanted)) & (F.col("content_hash") == wanted)).select(
            *LAYOUT.names)

    def known(self, hashes: DataFrame) -> DataFrame:
        """Stored hashes among ``hashes``. Other buckets than theirs are not opened."""
        asked = hashes.select("content_hash").withColumn("bucket", self._bucket(F.col("content_hash")))
        opened = self._in_buckets(asked).select("content_hash", "bucket")
        return opened.join(asked, ["content_hash", "bucket"], "left_semi").select("content_hash")

    def _in_buckets(self, asked: DataFrame) -> DataFrame:
        """The table's rows in the buckets of ``asked``, whose numbers are at most ``buckets`` rows."""
        numbers = [r.bucket for r in asked.select("bucket").distinct().collect()]
        return self._table().filter(F.col("bucket").isin(numbers))

    def _laid_out(self, rows: DataFrame) -> DataFrame:
        """Rows as they are written. Rebalancing keeps files even although one status holds most rows; sorted dates
        give narrow row-group ranges."""
        placed = rows.select(*LAYOUT.names, self._bucket(F.col("content_hash")).alias("bucket"))
        return placed.hint("rebalance", *PARTS).sortWithinPartitions(*PARTS, "date")

    def _write(self, laid_out: DataFrame, mode: str) -> None:
        laid_out.write.mode(mode).options(**BLOOM, partitionOverwriteMode="dynamic").partitionBy(*PARTS).parquet(self.root)

    def insert(self, processed: DataFrame, date_mode: str = "strict") -> dict[str, int]:
        """Store the rows that satisfy every constraint and are not stored yet. Returns how many were ``successful`` and
        how many ``failed``, counted while the rows are judged and written."""
        judged, written = Observation(), Observation()
        count = F.count(F.lit(1))
        valid = F.size(S.own_violations(processed, date_mode)) == 0
        batch = landed(processed.select("content_hash", "seq", valid.alias("valid")).observe(judged, count.alias("n")), "batch")
        hashes = batch.filter("valid").select("content_hash", "seq")
        winners = S.winners(hashes, self.known(hashes))
        good = processed.join(winners.select("seq"), "seq", "left_semi")
        # Observed after the last shuffle, so that a repeated task counts once.
        self._write(self._laid_out(_store_rows(good, date_mode)).observe(written, count.alias("n")), "append")
        stored = written.get["n"]
        return {"successful": stored, "failed": judged.get["n"] - stored}

    def _folders(self, hashes: DataFrame) -> list[Row]:
        """Buckets and statuses that hold any of ``hashes``: a few for each bucket."""
        asked = landed(hashes.select("content_hash").distinct().withColumn("bucket", self._bucket(F.col("content_hash"))), "asked")
        hit = self._in_buckets(asked).join(asked, ["bucket", "content_hash"], "left_semi")
        return hit.select(*PARTS).distinct().collect()

    def _overwrite(self, folders: Sequence[Row], rows: DataFrame) -> None:
        """Give ``folders`` the content ``rows``, which are written to a place of their own first: a failure on the
        way loses nothing."""
        if not folders:
            return
        kept = landed(rows.select(*LAYOUT.names), "kept")
        self._write(self._laid_out(kept), "overwrite")
        left = {tuple(r) for r in kept.select(self._bucket(F.col("content_hash")).alias("bucket"), "processing_status").distinct().collect()}
        for folder in folders:
            if tuple(folder) not in left:
                remove(self.spark, f"{self.root}/bucket={folder.bucket}/processing_status={folder.processing_status}")

    def _within(self, folders: Sequence[Row]) -> DataFrame:
        """The rows of ``folders``."""
        chosen = F.lit(False)
        for bucket in sorted({f.bucket for f in folders}):
            statuses = [f.processing_status for f in folders if f.bucket == bucket]
            chosen = chosen | ((F.col("bucket") == bucket) & F.col("processing_status").isin(statuses))
        return self._table().filter(chosen).select(*LAYOUT.names)

    def delete(self, hashes: DataFrame) -> None:
        """Remove articles by hash. Only folders that hold one are read and rewritten."""
        folders = self._folders(hashes)
        self._overwrite(folders, self._within(folders).join(hashes.select("content_hash"), "content_hash", "left_anti"))

    def upsert(self, processed: DataFrame, date_mode: str = "strict") -> None:
        """Replace or add the valid rows by hash. Only the folders that they leave or enter are rewritten."""
        changes = landed(_store_rows(S.insertable(processed, None, date_mode), date_mode), "changes")
        entered = changes.select(self._bucket(F.col("content_hash")).alias("bucket"), "processing_status").distinct()
        folders = list({*self._folders(changes), *entered.collect()})
        self._overwrite(folders, S.upsert(self._within(folders), changes))


def _store_rows(processed: DataFrame, date_mode: str) -> DataFrame:
    """Store columns plus the factor array, in one projection."""
    return processed.select(*S.store_columns(processed, date_mode), F.col("quality_factors"))


def missing_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Names of the required tables the catalog does not have."""
    prefix = f"{database}." if database else ""
    absent = [(name,) for name in REQUIRED_TABLES if not spark.catalog.tableExists(prefix + name)]
    return spark.createDataFrame(absent, "table_name string")
