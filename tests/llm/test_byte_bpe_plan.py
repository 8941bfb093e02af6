"""Byte BPE: what the driver keeps of its plans, how texts are cut, and decoding of bytes that are no text."""

import random

import public_tokenizers as P
import regex
from pyspark.sql import functions as F

from newsloom.llm import byte_bpe
from newsloom.llm.pretokens import chunks

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def test_plans_are_printed_without_the_whole_table_of_ranks(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = byte_bpe.encode(docs, RANKS, P.PATTERN).select(byte_bpe.decoded("ids", RANKS))
    assert len(found._jdf.queryExecution().toString()) < 400_000


def test_chunks_hold_the_same_pre_tokens_as_the_text():
    find, draw = regex.compile(P.PATTERN).findall, random.Random(1)
    for _ in range(20_000):
        text = "".join(draw.choice("ab1' .\n\t é　s\0\x1c\x85") for _ in range(draw.randrange(9)))
        assert [word for chunk in chunks(text) for word in find(chunk)] == find(text)


def test_every_byte_is_decoded(spark):
    ranks = byte_bpe.read_ranks(RANKS)
    ids = [ranks[bytes([b])] for b in range(256)]
    row = spark.createDataFrame([(ids,), ([],)], "ids array<int>").select("ids", byte_bpe.decoded("ids", RANKS).alias("back"))
    got = {len(r.ids): bytes(r.back) for r in row.filter(F.col("back").isNotNull()).collect()}
    assert got == {256: bytes(range(256)), 0: b""}


def test_ranks_are_no_part_of_parsed_text(spark, small, monkeypatch):
    parsed, expr = [], F.expr
    monkeypatch.setattr(F, "expr", lambda text: parsed.append(len(text)) or expr(text))
    byte_bpe.encode(spark.read.parquet(f"{small}/documents.parquet"), RANKS, P.PATTERN).select(byte_bpe.decoded("ids", RANKS))
    assert parsed and max(parsed) < 10_000
