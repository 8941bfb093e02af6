"""How often plans read and hash the text, and what they aggregate."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from newsloom.operators import annotate as N
from newsloom.operators import dedup as D
from newsloom.operators import store as S
from newsloom.plans import process as P
from newsloom.profiles import PROFILE_A, PROFILE_B
from newsloom.sources import landing


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def landings(monkeypatch):
    """The plans of all narrow rows that are landed."""
    seen = []

    def recorded(frame, name):
        seen.append(plan(frame))
        return landing.landed(frame, name)

    for module in (D, N, P, S):
        monkeypatch.setattr(module, "landed", recorded)
    return seen


def text_scans(plans):
    return sum(len(re.findall(r"FileScan parquet \[[^\]]*\btext#", text)) for text in plans)


@pytest.mark.parametrize("name", [
    "d3_dedup_a", "d4_dedup_b", "d6_duplicate_report_a", "d6_duplicate_report_b", "e2_dedup_by_title",
    "n8_route_status_a", "n10_run_summary_a", "n10_run_summary_b"])
def test_text_is_read_and_hashed_once(spark, small, landings, name):
    last = plan(contract.queries()[name](spark, small))
    plans = [*landings, last]
    assert text_scans(plans) == 1
    assert sum(text.count("md5(") for text in plans) <= 1
    assert "SortAggregate" not in "".join(plans)


def test_scorer_texts_are_not_aggregated(spark, small, landings):
    text = plan(contract.queries()["n7_batch_annotate_a"](spark, small))
    for line in "\n".join([*landings, text]).splitlines():
        if "Aggregate" in line:
            assert "content#" not in line
    assert text_scans([*landings, text]) == 2


def test_constraints_and_inserts_aggregate_numbers(spark, small, landings):
    for name in ("r7_constraint_check", "r2_batch_counts", "r6_insert_if_new"):
        text = plan(contract.queries()[name](spark, small))
        assert "min_by" not in text and "max_by" not in text


def test_only_texts_that_pass_the_gate_reach_the_scorer(spark):
    import pandas as pd

    good = "A sentence on chips. " * 60
    rows = [(0, "2024-01-01", "headline of some length", good, "u", "s"), (1, "", "", good, "", "s"), (2, "", "h", "short", "", "s"),
            (3, "", "h", "", "", "s"), (4, "", "h", None, "", "s")]
    frame = spark.createDataFrame(rows, "seq long, date string, headline string, content string, article_url string, source_url string")
    seen = spark.sparkContext.accumulator(0)

    def scorer(texts):
        seen.add(len(texts))
        return pd.DataFrame({"sentiment": "利好", "summary": texts.str.len().astype(str), "relevant": "是"})

    got = {r.seq: r.processing_status for r in P.process_with_scorer(frame, scorer, PROFILE_A, ["chip"]).collect()}
    assert got == {0: "success", 2: "low_quality"} and seen.value == 1


def test_a_hot_hash_is_a_row_for_each_task(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("seq"), F.lit("h").alias("headline"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 900)).alias("content"))
    kept = sorted(r.seq for r in D.unique_rows(rows, PROFILE_B).collect())
    first = {}
    for r in rows.collect():
        first.setdefault(r.content, r.seq)
    assert kept == sorted(first.values())
    assert sorted(r.seq for r in D.deduplicate(rows, PROFILE_B).collect()) == kept
