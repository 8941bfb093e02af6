"""The store by hash: what a lookup opens, what a change rewrites, what an insert counts."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F
from test_store import BASE, NAMES

from newsloom.operators import store as S
from newsloom.plans import process as P
from newsloom.profiles import PROFILE_A
from newsloom.schemas import PROCESSED_ARTICLE
from newsloom.sources.tables import ArticleStore
from newsloom.streaming.incremental import ingest, raw_stream


def articles(spark, count, **changes):
    """Valid articles with scattered hashes, of two statuses."""
    fixed = {k: v for k, v in {**BASE, **changes}.items() if k not in ("content_hash", "processing_status", "quality_factors")}
    rows = spark.range(count).select(
        F.col("id").alias("seq"), F.md5(F.col("id").cast("string")).alias("content_hash"),
        F.when(F.col("id") % 3 == 0, "failed").otherwise("success").alias("processing_status"),
        F.array(F.lit("long")).alias("quality_factors"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    return rows.select("seq", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in PROCESSED_ARTICLE.fields])


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    store = ArticleStore(spark, str(tmp_path_factory.mktemp("store") / "s"), buckets=4)
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(64 << 10))
    try:
        store.insert(articles(spark, 40_000))
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    return store


def scanned(frame):
    """Rows that a scan hands on, and the files that it opens."""
    frame.collect()
    found = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            metrics = node.metrics()
            found.append((metrics.apply("numOutputRows").value(), metrics.apply("numFiles").value()))
        if name == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif name.endswith("QueryStage"):
            walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(frame._jdf.queryExecution().executedPlan())
    return found


def row_groups(root):
    import pyarrow.parquet as pq

    return sum(pq.ParquetFile(f).num_row_groups for f in glob.glob(f"{root}/**/*.parquet", recursive=True))


def test_a_lookup_opens_one_bucket_and_few_row_groups(spark, filled):
    groups, total = row_groups(filled.root), filled.rows().count()
    assert groups >= 32 and total == 40_000
    (rows, files), = scanned(filled.get(filled.rows().agg(F.max("content_hash")).first()[0]))
    assert files <= 2 * len(glob.glob(f"{filled.root}/bucket=0/*/*.parquet")) and files < len(
        glob.glob(f"{filled.root}/**/*.parquet", recursive=True))
    # Bloom filters leave the one row group that holds it, with room for a false hit.
    assert 0 < rows <= 3 * total / groups
    (rows, _), = scanned(filled.get("0" * 32))
    assert rows <= 2 * total / groups


def test_lookups_find_what_is_there(spark, filled):
    for i in random.Random(1).sample(range(40_000), 5):
        name = spark.range(1).select(F.md5(F.lit(str(i)))).first()[0]
        assert [r.content_hash for r in filled.get(name).collect()] == [name]
    asked = articles(spark, 50).select("content_hash").unionByName(spark.range(1).select(F.lit("nobody").alias("content_hash")))
    assert filled.known(asked).count() == 50


def times(store):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{store.root}/**/*.parquet", recursive=True)}


def in_folders(files):
    return {os.path.dirname(f) for f in files}


def test_changes_leave_other_files_alone(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "s"))
    store.insert(articles(spark, 400))
    before, rows = times(store), {r.content_hash: r for r in store.rows().collect()}
    victim = min(rows)
    store.delete(spark.createDataFrame([(victim,), ("nobody",)], "content_hash string"))
    after = times(store)
    assert sorted(r.content_hash for r in store.rows().collect()) == sorted(set(rows) - {victim})
    assert len(in_folders([f for f, _ in set(before.items()) ^ set(after.items())])) == 1
    store.delete(spark.createDataFrame([("nobody",)], "content_hash string"))
    assert times(store) == after

    other = next(h for h in sorted(rows) if rows[h].processing_status == "success" and h != victim)
    change = articles(spark, 400).filter(F.col("content_hash") == other).withColumn("processing_status", F.lit("error"))
    store.upsert(change)
    touched = [f for f, _ in set(after.items()) ^ set(times(store).items())]
    assert len(in_folders(touched)) == 2
    found = store.get(other).collect()
    assert [r.processing_status for r in found] == ["error"] and found[0].created_at == rows[other].created_at
    assert store.rows().count() == 399


def test_an_emptied_folder_goes(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "s"), buckets=2)
    store.insert(articles(spark, 1))
    name = store.rows().first().content_hash
    store.delete(spark.createDataFrame([(name,)], "content_hash string"))
    assert store.rows().count() == 0 and store.get(name).count() == 0
    assert store.insert(articles(spark, 2)) == {"successful": 2, "failed": 0}


def test_counts_come_from_the_insert(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "s"))
    rows = articles(spark, 60).withColumn(
        "sentiment", F.when(F.col("seq") % 7 == 0, "other").otherwise(F.col("sentiment")))
    rows = rows.unionByName(rows.withColumn("seq", F.col("seq") + 100))
    for _ in range(2):
        verdict = S.batch_counts(S.verdicts(rows, store.articles())).first().asDict()
        assert store.insert(rows) == verdict
    assert verdict == {"successful": 0, "failed": 120}
    assert store.rows().count() == 51


def test_replies_are_found_by_content_in_every_batch(spark, tmp_path):
    """Two batches, each numbered from 0; the reply of an article is that of its content."""
    import json

    store = ArticleStore(spark, str(tmp_path / "s"))
    body = "A sentence on {} that is long enough to be scored well. " * 40
    names = [f"n{i}" for i in range(6)]

    raw = spark.createDataFrame([("2024-01-01", f"Headline of {n}", body.replace("{}", n), f"https://x/{n}", "https://x") for n in names],
                                "date string, headline string, content string, article_url string, source_url string")
    from newsloom.functions.hashing import normalised_hash

    hashes = {r.headline[-2:]: r.h for r in raw.select("headline", normalised_hash(F.col("content")).alias("h")).collect()}
    replies = spark.createDataFrame([(hashes[n], 1, 200, json.dumps({"choices": [{"message": {"content": json.dumps(
        {"sentiment": "利好", "summary": f"on {n}", "relevant": "是"}, ensure_ascii=False)}}]})) for n in names],
        "content_hash string, attempt int, status int, body string")
    for part in (names[:4], names[2:]):
        raw.filter(F.substring("headline", -2, 2).isin(part)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        ingest(raw_stream(spark, str(tmp_path / "in"), lines=True), store, str(tmp_path / "check"),
               lambda rows: P.process(rows, replies, PROFILE_A, ["sentence"])).awaitTermination()
    assert {r.content_hash: r.summary for r in store.rows().collect()} == {hashes[n]: f"on {n}" for n in names}
    assert store.rows().count() == 6
