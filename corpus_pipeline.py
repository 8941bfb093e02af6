"""From raw documents to an encoded training mix, in five stages.

Each stage reads all that its predecessor kept, written as Parquet in between, and its decisions take
effect on the rows that follow. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import byte_bpe, exact_dedup, language, mixing, near_copies
from newsloom.llm.common import table, written
from newsloom.llm.stages import decided, keyed, plain, take_copies
from newsloom.registry.base import Registry

# Below this a text is prose of no learned language. All whole texts of the given tables are above 0.4.
LEAST_LIKE = 0.3
RANKS = "byte_bpe_multi_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of some learned language; those without letters, or far from every profile, go."""
    named, (doc_id, text, lang, _) = plain(docs)
    # Python workers of other stages share the executors' memory.
    found = language.identify(
        named, F.col(lang).isNotNull(), doc_id, text, lang, carry=named.columns, remembered=1 << 16)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LIKE)).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    found = exact_dedup.exact_dedup(keyed(docs))
    return take_copies(docs, decided(found, F.col("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, pairs with at least 0.8 of their five-word shingles in common, the row with
    the smallest doc_id stays; of several rows with that identifier, the one of the smallest digest."""
    found = near_copies.near_groups(keyed(docs))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("first"))
    return take_copies(docs, decided(first.select("first.doc_id", "first.digest"), F.lit(1)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    found = mixing.mix(keyed(docs), carry=("digest",))
    return take_copies(docs, decided(found, F.col("copies")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the bytes that they decode to."""
    path = public_tokenizers.path(RANKS)
    # The driver's memory also holds what the stages before left behind.
    found = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, frequent=1 << 19)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(byte_bpe.decoded("ids", path), 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

# Languages, fingerprints and ids are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None

REGISTRY = Registry()


@REGISTRY.add("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
