"""Every stage of the pipeline against a brute-force version of it, on the given documents and planted cases."""

import collections
import hashlib

import corpus_pipeline
import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from test_edge_cases import lowered
from test_near_copies import staying

from newsloom.llm.byte_bpe import read_ranks
from newsloom.llm.common import written
from newsloom.llm.queries import MIXING_SQL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def planted(rows):
    """Rows without letters, copies in other letters and one almost equal long text."""
    long = max((r for r in rows if len(r.text.split()) > 300), key=lambda r: len(r.text))
    words = long.text.split(" ")
    words[len(words) // 2] += "x"
    return [
        (9001, None, "en", "src0", 0), (9002, "", "en", "src0", 0), (9003, "12 34 !?", "en", "src1", 8),
        (9004, rows[3].text.upper(), "en", "src1", 1), (9005, rows[3].text, None, None, 1), (9006, " ".join(words), "en", "src2", 1),
        (9005, rows[3].text, None, None, 1)]


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(*COLUMNS)
    rows = docs.collect()
    docs = written(docs.unionByName(spark.createDataFrame(planted(rows), docs.schema)), "pipeline-test")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(written(stage(spark, found[-1], small), f"pipeline-test-{name}"))
    return found


def test_columns(stages):
    assert all(frame.columns == COLUMNS for frame in stages[:-1])


def test_language_drops_texts_without_letters_only(stages):
    before, after = (collections.Counter(map(tuple, f.collect())) for f in stages[:2])
    assert sorted(r[0] for r in (before - after).elements()) == [9001, 9002, 9003]
    assert not after - before


def test_exact_dedup_keeps_the_largest_identifier(stages):
    groups = collections.defaultdict(list)
    for r in stages[1].collect():
        groups[lowered(r.text)].append(tuple(r))
    want = collections.Counter(max(g, key=lambda r: r[0]) for g in groups.values())
    assert collections.Counter(map(tuple, stages[2].collect())) == want


def test_near_dedup_keeps_one_of_each_component(stages):
    rows = stages[2].collect()
    kept = set(staying([(r.doc_id, lowered(r.text)) for r in rows]))
    assert collections.Counter(map(tuple, stages[3].collect())) == collections.Counter(tuple(r) for r in rows if r.doc_id in kept)
    assert 9006 not in kept


def test_mixing_takes_what_the_sql_says(stages):
    documents = stages[3].toPandas()  # noqa: F841 (DuckDB reads it by name)
    copies = {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, copies FROM ({MIXING_SQL})").fetchall()}
    rows = {r.doc_id: tuple(r) for r in stages[3].collect()}
    want = collections.Counter({rows[i]: n for i, n in copies.items() if n})
    assert collections.Counter(map(tuple, stages[4].collect())) == want


def test_encoding_is_that_of_the_library_and_decodes(stages):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks=read_ranks(
        P.path("byte_bpe_multi_50k.tiktoken")))
    want = collections.Counter()
    for r in stages[4].collect():
        ids = library.encode_ordinary(r.text)
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, stages[5].collect())) == want


def test_run_goes_through_all_stages(spark, small, stages):
    assert corpus_pipeline.run(spark, small).columns == stages[-1].columns
