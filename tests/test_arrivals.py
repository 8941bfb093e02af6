"""What the store's queries compute once, and that texts stay where they are read."""

from newsloom.plans import process as P
from newsloom.registry import storing
from newsloom.sources import articles as A


def test_a_rewrite_processes_its_articles_once(spark, small, monkeypatch):
    calls, own = [], P.process
    monkeypatch.setattr(P, "process", lambda *given: calls.append(1) or own(*given))
    assert storing.store_rewrite(spark, small).count() > 0
    assert len(calls) == 1


def test_numbering_does_not_shuffle_the_texts(spark, tmp_path):
    """However large Spark takes the table of blocks for."""
    spark.range(50).selectExpr("'' as date", "'' as headline", "cast(id as string) as content", "'' as article_url",
                               "'' as source_url").write.json(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = A.read_raw(spark, str(tmp_path / "in"), lines=True)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
        assert sorted(r.seq for r in rows.collect()) == list(range(50))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_articles_equal_in_all_fields_are_stored_once(spark, tmp_path):
    """Numbers 77 and 154 get neither date nor URL, so that nothing tells the two articles apart."""
    text = "A headline\n" + "A sentence that is long enough to count. " * 30
    spark.createDataFrame([(i, text, "src") for i in (77, 154)], "doc_id long, text string, source string").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(77, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert storing.incremental_runs(spark, str(tmp_path)).count() == 1
