"""Constraints, lookups, changes, files and migration."""

import datetime
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from newsloom.operators import store as S
from newsloom.plans import migrate as M
from newsloom.plans import process as P
from newsloom.profiles import PROFILE_A
from newsloom.schemas import PROCESSED_ARTICLE, RAW_ARTICLE
from newsloom.sources import articles as A
from newsloom.sources import tables as T
from newsloom.sources.pages import latest_snapshots
from newsloom.streaming.incremental import ingest, raw_stream

# A file of 38 processed articles, if one is at hand.
SAMPLE = os.environ.get("NEWSLOOM_SAMPLE", "")
BASE = {
    "date": "2025-01-01", "headline": "A stored article", "article_url": "https://example.com/a",
    "source_url": "https://example.com", "content_hash": "kept-0042", "quality_score": 8,
    "quality_factors": ["long", "on_topic", "dated"], "content_length": 1500,
    "sentence_count": 15, "tech_keyword_count": 5, "sentiment": "中立", "summary": "一篇文章",
    "relevant": "是", "processing_status": "success",
}
NAMES = [f.name for f in PROCESSED_ARTICLE.fields]


def batch(spark, *changes):
    rows = [[{**BASE, **c}[n] for n in NAMES] for c in changes]
    frame = spark.createDataFrame(rows, PROCESSED_ARTICLE).coalesce(1)
    return A.with_seq(frame)


def test_constraints(spark):
    rows = batch(
        spark, {}, {"sentiment": "中性", "content_hash": "h1"}, {"headline": None, "content_hash": "h2"},
        {"content_hash": "h" * 33}, {}, {"relevant": "yes", "content_hash": "h3"},
        {"date": "", "content_hash": "h4"}, {"date": None, "content_hash": "h5"},
        {"quality_factors": ["f" * 51], "content_hash": "h6"}, {"content_hash": "old"},
        {"sentiment": "x", "content_hash": "late"}, {"content_hash": "late"})
    stored = spark.createDataFrame([("old",)], "content_hash string")
    got = [list(r.violations) for r in S.check(rows, stored).orderBy("seq").collect()]
    assert got == [
        [], ["sentiment_unknown"], ["headline_missing"], ["content_hash_too_long"], ["content_hash_taken"],
        ["relevant_unknown"], ["date_invalid"], [], ["factor_too_long"], ["content_hash_taken"],
        ["sentiment_unknown"], []]
    checked = S.check(rows, stored)
    assert S.batch_counts(checked).first().asDict() == {"successful": 3, "failed": 9}
    direct = {r.content_hash for r in S.insertable(rows, stored).collect()}
    assert direct == {r.content_hash for r in S.accepted(checked).collect()} == {"kept-0042", "h5", "late"}
    assert S.rejected(checked).count() == 9
    lenient = S.check(rows, stored, "lenient").orderBy("seq").collect()
    assert lenient[6].violations == []


def test_store_life_cycle(spark, tmp_path):
    store = T.ArticleStore(spark, str(tmp_path / "store"))
    assert store.rows().count() == 0
    store.insert(batch(spark, {}, {"content_hash": "h1", "date": "2025-02-01", "quality_factors": []}))
    store.insert(batch(spark, {}, {"content_hash": "h2", "date": "2025-03-01", "processing_status": "failed"}))
    articles, factors = store.articles(), store.factors()
    assert S.count_rows(articles).first()[0] == 3
    row = S.by_hash(articles, factors, "kept-0042").first()
    assert row.quality_factors == BASE["quality_factors"] and row.date == datetime.date(2025, 1, 1)
    assert S.by_hash(articles, factors, "h1").first().quality_factors is None
    assert S.by_hash(articles, factors, "nobody").count() == 0
    days = S.by_date_range(articles, factors, "2025-01-01", "2025-02-01").collect()
    assert [(r.content_hash, len(r.quality_factors)) for r in days] == [("h1", 0), ("kept-0042", 3)]
    assert {r.content_hash for r in S.recent(articles, factors, 3).collect()} == {"h1", "h2", "kept-0042"}
    assert S.find(articles, F.col("processing_status") == "failed").count() == 1
    gone = spark.createDataFrame([("kept-0042",), ("nobody",)], "content_hash string")
    assert {r.content_hash: r.deleted for r in S.deletion_report(articles, gone).collect()} == {
        "kept-0042": True, "nobody": False}
    before = {r.content_hash: r.created_at for r in articles.collect()}
    store.delete(gone)
    assert {r.content_hash for r in store.articles().collect()} == {"h1", "h2"}
    assert {r.content_hash for r in store.factors().collect()} == {"h2"}
    store.upsert(batch(spark, {"content_hash": "h2", "sentiment": "利好"}, {"content_hash": "h3"}))
    after = {r.content_hash: r for r in store.articles().collect()}
    assert set(after) == {"h1", "h2", "h3"} and after["h2"].sentiment == "利好"
    assert after["h2"].created_at == before["h2"] and after["h2"].updated_at > before["h2"]
    assert after["h1"].updated_at == before["h1"]


def test_status_lines(spark):
    rows = S.to_store_rows(batch(spark, {"headline": "x" * 60}, {"content_hash": "h", "date": None}), "lenient",
                           F.timestamp_seconds(F.col("seq")))
    got = S.status_lines(rows).collect()
    assert got[0].line == "[None] A stored article... (Q:8)" and got[0].article_count == 2
    assert got[1].line == f"[2025-01-01] {'x' * 40}... (Q:8)"


def test_projection_fills_missing_columns(spark):
    row = S.to_store_rows(spark.createDataFrame([("h",)], "content_hash string")).first()
    assert row.content_hash == "h" and row.headline is None and row.date is None and row.created_at


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_raw_scan(spark, tmp_path):
    good = write(tmp_path / "good.json", [{"headline": "a", "content": "中"}, {"headline": "b", "content": None, "x": 1}])
    rows = A.read_raw(spark, good).orderBy("seq").collect()
    assert [(r.headline, r.content, r.date) for r in rows] == [("a", "中", None), ("b", None, None)]
    broken = write(tmp_path / "broken.json", '[{"headline":"a"}, oops')
    with pytest.raises(PySparkException):
        A.read_raw(spark, str(tmp_path / "absent.json"))
    with pytest.raises(Exception):
        A.read_raw(spark, broken).collect()
    for path in (broken, str(tmp_path / "absent.json")):
        lenient = A.read_raw(spark, path, strict=False)
        assert lenient.count() == 0 and lenient.columns == [*RAW_ARTICLE.names, "seq"]


def test_numbered_and_stamped_outputs(spark, tmp_path):
    rows = spark.createDataFrame([("a",)], "headline string")
    assert [A.append_numbered(rows, str(tmp_path / "runs")) for _ in range(2)] == [1, 2]
    assert sorted(r.run_id for r in A.read_numbered(spark, str(tmp_path / "runs")).collect()) == [1, 2]
    first = A.timestamped_path(spark, str(tmp_path), "out")
    os.mkdir(first)
    second = A.timestamped_path(spark, str(tmp_path), "out")
    assert first != second


def test_snapshots_last_wins(spark):
    rows = spark.createDataFrame(
        [(1, "https://a/b", "x"), (3, "http://a/b", "z"), (2, "https://a/b", "y")], "seq long, url string, html string")
    got = latest_snapshots(rows).collect()
    assert [(r.snapshot_key, r.html) for r in got] == [("downloaded_a_b.html", "z")]


def test_migration_of_files(spark, tmp_path):
    one = write(tmp_path / "one.json", [BASE, {**BASE, "content_hash": "h1"}])
    two = write(tmp_path / "two.json", [{**BASE, "content_hash": "h2"}, {**BASE, "content_hash": "h3", "sentiment": "中性"}])
    store = T.ArticleStore(spark, str(tmp_path / "store"))
    verdicts = M.migrate(spark, [one, two], store)
    got = {r.file.rsplit("/", 1)[1]: (r.articles, r.inserted, r.failed, r.success) for r in verdicts.collect()}
    assert got == {"one.json": (2, 2, 0, True), "two.json": (2, 1, 1, False)}
    assert M.migrated_total(verdicts).first()[0] == 2
    assert store.rows().count() == 3


@pytest.mark.skipif(not os.path.exists(SAMPLE), reason="sample file not present")
def test_sample_invariants(spark, tmp_path):
    rows = A.read_processed(spark, SAMPLE)
    assert rows.count() == 38 and rows.select("content_hash").distinct().count() == 38
    by_status = {r.processing_status: r["count"] for r in rows.groupBy("processing_status").count().collect()}
    assert by_status == {"success": 25, "failed": 10, "low_quality": 3}
    summary = P.summary_of(rows).first()
    assert (summary.relevant_count, round(summary.avg_quality, 4)) == (21, 8.0789)
    from newsloom.operators.quality import grade
    counts = rows.drop("quality_score", "quality_factors")
    regraded = grade(counts, PROFILE_A).select(
        "content_hash", F.col("quality_score").alias("score"), F.col("quality_factors").alias("factors"))
    assert rows.join(regraded, "content_hash").filter("score = quality_score AND factors = quality_factors").count() == 38
    strict = S.batch_counts(S.check(rows)).first()
    assert (strict.successful, strict.failed) == (31, 7)
    assert S.batch_counts(S.check(rows, date_mode="lenient")).first().failed == 0


def test_required_tables(spark):
    assert {r[0] for r in T.missing_tables(spark).collect()} == {"articles", "quality_factors"}
    spark.createDataFrame([("h",)], "content_hash string").createOrReplaceTempView("articles")
    try:
        assert {r[0] for r in T.missing_tables(spark).collect()} == {"quality_factors"}
    finally:
        spark.catalog.dropTempView("articles")


def test_incremental_runs_skip_known_articles(spark, tmp_path):
    arriving, root = tmp_path / "arriving", str(tmp_path / "store")
    arriving.mkdir()
    store = T.ArticleStore(spark, root)
    no_replies = spark.createDataFrame([], "seq long, attempt int, status int, body string")

    def run():
        ingest(raw_stream(spark, str(arriving)), store, str(tmp_path / "checkpoint"),
               lambda rows: P.process(rows, no_replies, PROFILE_A)).awaitTermination()

    def article(text):
        return {"headline": "h", "content": text, "date": "2025-01-01", "article_url": "u", "source_url": "s"}

    write(arriving / "1.json", [article("one"), article("two"), article("ONE ")])
    run()
    assert store.rows().count() == 2
    write(arriving / "2.json", [article("two"), article("three")])
    run()
    run()
    assert store.rows().count() == 3
