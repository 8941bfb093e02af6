"""Making decisions about documents take effect on their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import NO_ID, ascii_lower, or_blank, written
from newsloom.llm.exact_dedup import sha256


def plain(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns named by their places, which cannot clash with a helper column, and the names of
    ``doc_id, text, lang, source`` among them."""
    places = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*places.values()), [places[c] for c in ("doc_id", "text", "lang", "source")]


def text_digest(text_col: str):
    return sha256(ascii_lower(or_blank(F.col(text_col))))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, source`` with the ``digest`` that, beside the identifier, stands for a row."""
    named, (doc_id, text, _, source) = plain(docs)
    return named.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"),
        text_digest(text).alias("digest"))


def decided(rows: DataFrame, copies) -> DataFrame:
    """Decisions for ``take_copies`` from rows with ``doc_id`` and ``digest``."""
    return rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("ident"), "digest", copies.cast("int").alias("copies"))


def take_copies(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every row of ``docs`` as often as ``decisions`` (``ident, digest, copies``) say, with its columns as they were.

    Rows repeated with one identifier and text are told apart by nothing: one of them stands for all, with
    the copies of all. Rows without a decision go.
    """
    named, (doc_id, text, _, _) = plain(docs)
    per_key = written(decisions.groupBy("ident", "digest").agg(
        F.sum("copies").cast("int").alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0"), "copies")
    packed = named.select(
        F.struct(*named.columns).alias("packed"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("ident"),
        text_digest(text).alias("digest"))
    joined = packed.join(per_key, ["ident", "digest"])
    taken = joined.filter("rows = 1")
    if not per_key.filter("rows > 1").isEmpty():
        taken = taken.unionByName(joined.filter("rows > 1").dropDuplicates(["ident", "digest"]))
    return taken.withColumn("packed", F.explode(F.expr("array_repeat(packed, copies)"))).select(
        *[F.col(f"packed.c{i}").alias(c) for i, c in enumerate(docs.columns)])
