"""The numbered queries over whole given tables: against SQL where it exists, else against what must hold."""

import compare
import numpy as np
import pyarrow.parquet as pq
import pytest

from newsloom.llm import exact_dedup, url_filter
from newsloom.llm.common import table
from newsloom.llm.queries import REGISTRY


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_sql(spark, small, name):
    assert compare.compare(spark, compare.connect(small), name, small) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY.queries) == list(range(1, 14))


def test_recall_of_the_permutation_index(spark):
    folder = "/root/testdata/sf0.1"
    got = {}
    for r in REGISTRY.queries["op8_permutation_index"](spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = pq.read_table(f"{folder}/embeddings.parquet")
    ids, vectors = np.array(rows["vec_id"].to_pylist()), np.array(rows["embedding"].to_pylist(), np.float64)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        near = [int(ids[i]) for i in np.argsort(-(vectors @ vectors[at])) if i != at][:5]
        hits, total = hits + len(got[ids[at]] & set(near)), total + 5
    assert hits / total >= 0.9


def test_held_out_language(spark, small):
    rows = REGISTRY.queries["op9_language"](spark, small).join(table(spark, small, "documents").select("doc_id", "lang"), "doc_id")
    asked = rows.filter("held_out").collect()
    assert asked and sum(r.lang == r.lang_pred for r in asked) / len(asked) >= 0.95


def test_hot_url_and_state_plans(spark, small):
    """No text of unique documents moves in exact dedup, and the URL join is on short digests."""
    judged = url_filter.judge_urls(table(spark, small, "pages"), url_filter.rule_table(spark))
    joins = [line for line in judged._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert len(joins) == 1 and "short#" in joins[0] and "digest" not in joins[0]
    rows = exact_dedup.contents(table(spark, small, "documents"), "doc_id", "text", exact_dedup.sha256)
    none = spark.createDataFrame([], "digest binary")
    assert exact_dedup.only_hits(rows, none).count() == 0
