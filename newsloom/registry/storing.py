"""Queries of the article store, file sources and sinks, and scheduled runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import store as S
from newsloom.plans import migrate as M
from newsloom.plans import process as P
from newsloom.profiles import PROFILE_A, PROFILE_B
from newsloom.registry import views as V
from newsloom.registry.base import Registry
from newsloom.session import scratch_path
from newsloom.sources import articles as A
from newsloom.sources.landing import landed
from newsloom.sources.tables import ArticleStore
from newsloom.streaming.incremental import ingest, raw_stream

REGISTRY = Registry()
add = REGISTRY.add

PROCESSED = f"WITH {V.sql_processed(PROFILE_A)}"
# Stored rows carry a creation time that follows ``seq`` in scattered order.
STORE = f"""{PROCESSED}, store AS (SELECT *, try_cast(nullif(date, '') AS DATE) AS day,
  (seq * 7919) % 100003 AS created FROM processed)"""


def processed(spark, folder, profile=PROFILE_A):
    """Processed articles, written down once: the queries below read them several times."""
    return landed(P.process(
        V.articles(spark, folder), V.responses(spark, folder), profile, V.KEYWORDS), "processed")


def tables(spark, folder):
    return tables_of(processed(spark, folder))


def tables_of(rows):
    created = F.timestamp_seconds((F.col("seq") * 7919) % 100003)
    return S.to_store_rows(rows, "lenient", created), S.factor_rows(rows)


def _view(rows, *more):
    return rows.select("content_hash", F.col("date").cast("string").alias("date"), "headline",
                       F.col("quality_score").cast("long").alias("quality_score"), *more)


def _factors(column="quality_factors"):
    return F.concat_ws(",", column).alias("factors")


# --- constraints and inserts ----------------------------------------------------------------

@add("p5_store_projection", f"""{STORE} SELECT content_hash, CAST(day AS VARCHAR) AS date, headline, article_url,
  source_url, content_length, quality_score, sentiment, relevant, processing_status, created AS created_second FROM store""")
def store_projection(spark, folder):
    articles, _ = tables(spark, folder)
    return articles.select(
        "content_hash", F.col("date").cast("string").alias("date"), "headline", "article_url", "source_url",
        *[F.col(c).cast("long").alias(c) for c in ("content_length", "quality_score")],
        "sentiment", "relevant", "processing_status",
        F.unix_timestamp("created_at").alias("created_second"))


@add("p3_drop_bulky_column", f"{PROCESSED} SELECT seq, content_hash, processing_status FROM processed")
def drop_bulky(spark, folder):
    rows = processed(spark, folder)
    assert "content" not in rows.columns
    return rows.select("seq", "content_hash", "processing_status")


@add("r1_insert_factors", f"""{PROCESSED}, l AS (SELECT content_hash, string_split(factors, ',') AS f FROM processed)
SELECT content_hash, unnest(range(len(f))) AS pos, unnest(f) AS factor_name FROM l""")
def insert_factors(spark, folder):
    _, factors = tables(spark, folder)
    return factors.withColumn("pos", F.col("pos").cast("long"))


# A batch with duplicates, replies outside the closed sets, missing and empty dates.
def batch(spark, folder):
    rows = processed(spark, folder, PROFILE_B)
    answers = V.answers(spark, folder).select("seq", F.col("sentiment").alias("raw_sentiment"))
    return rows.join(answers, "seq", "left").select(
        "seq", F.md5(F.col("headline")).alias("content_hash"),
        F.when(F.col("headline") != "", F.col("headline")).alias("headline"),
        F.when(F.col("seq") % 5 != 0, F.col("date")).alias("date"),
        "article_url", "source_url", "content_length", "sentence_count", "tech_keyword_count",
        "quality_score", "quality_factors",
        F.coalesce("raw_sentiment", F.lit("中立")).alias("sentiment"), "summary", "relevant",
        "processing_status")


BATCH = f"""WITH {V.sql_processed(PROFILE_B)},
batch AS (SELECT p.seq, md5(headline) AS content_hash, headline, p.date,
    CASE WHEN headline = '' THEN 'headline_missing' END AS v1,
    CASE WHEN a.sentiment = 'positive' THEN 'sentiment_unknown' END AS v2,
    CASE WHEN p.seq % 5 <> 0 AND p.date = '' THEN 'date_invalid' END AS v3
  FROM processed p LEFT JOIN ans a ON p.seq = a.seq),
own AS (SELECT *, concat_ws(',', v1, v2, v3) AS own FROM batch),
ranked AS (SELECT *, row_number() OVER (PARTITION BY content_hash, own = '' ORDER BY seq) AS n FROM own),
checked AS (SELECT *, CASE WHEN own <> '' THEN own WHEN n > 1 OR contains('0123', content_hash[1:1]) THEN 'content_hash_taken'
  ELSE '' END AS violations FROM ranked)"""


def stored_before(spark, folder):
    """Hashes already in the store: those that start with 0 to 3."""
    return V.articles(spark, folder).select(F.md5("headline").alias("content_hash")).filter(
        F.substring("content_hash", 1, 1).isin("0", "1", "2", "3")).distinct()


def _checked(spark, folder):
    return S.verdicts(batch(spark, folder), stored_before(spark, folder))


@add("r7_constraint_check", f"{BATCH} SELECT seq, content_hash, violations FROM checked")
def constraint_check(spark, folder):
    return _checked(spark, folder).select(
        "seq", "content_hash", F.concat_ws(",", "violations").alias("violations"))


@add("r2_batch_counts", f"""{BATCH} SELECT count(*) FILTER (violations = '') AS successful,
  count(*) FILTER (violations <> '') AS failed FROM checked""")
def batch_counts(spark, folder):
    return S.batch_counts(_checked(spark, folder))


@add("r6_insert_if_new", f"{BATCH} SELECT seq, content_hash FROM checked WHERE violations = ''")
def insert_if_new(spark, folder):
    return S.insertable(batch(spark, folder), stored_before(spark, folder)).select("seq", "content_hash")


@add("r6_exists_check", f"{BATCH} SELECT seq, content_hash FROM batch WHERE contains('0123', content_hash[1:1])")
def exists_check(spark, folder):
    return S.only_known(batch(spark, folder), stored_before(spark, folder)).select("seq", "content_hash")


# --- lookups --------------------------------------------------------------------------------

# Looked up by the lowest stored hash, a key that exists at every size.
@add("r3_get_by_hash", f"""{STORE} SELECT content_hash, CAST(day AS VARCHAR) AS date, headline, quality_score, factors
FROM store WHERE content_hash = (SELECT min(content_hash) FROM store)""")
def get_by_hash(spark, folder):
    articles, factors = tables(spark, folder)
    lowest = articles.agg(F.min("content_hash")).first()[0]
    return _view(S.by_hash(articles, factors, lowest), _factors())


@add("r4_date_range", f"""{STORE} SELECT content_hash, CAST(day AS VARCHAR) AS date, headline, quality_score, factors
FROM store WHERE day BETWEEN DATE '2024-03-01' AND DATE '2024-06-30'""")
def date_range(spark, folder):
    return _view(S.by_date_range(*tables(spark, folder), "2024-03-01", "2024-06-30"), _factors())


@add("r5_recent", f"""{STORE} SELECT content_hash, CAST(day AS VARCHAR) AS date, headline, quality_score, factors
FROM store ORDER BY created DESC, content_hash LIMIT 10""")
def recent(spark, folder):
    return _view(S.recent(*tables(spark, folder), 10), _factors())


@add("r8_count", f"{STORE} SELECT count(*) AS article_count FROM store")
def count_rows(spark, folder):
    return S.count_rows(tables(spark, folder)[0])


@add("r12_find", f"""{STORE} SELECT content_hash, CAST(day AS VARCHAR) AS date, headline, quality_score FROM store
WHERE processing_status = 'success' AND quality_score >= 8 AND sentiment = '利好'""")
def find(spark, folder):
    where = (F.col("processing_status") == "success") & (F.col("quality_score") >= 8) & (
        F.col("sentiment") == "利好")
    return _view(S.find(tables(spark, folder)[0], where))


@add("r13_status_report", f"""{STORE} SELECT content_hash, (SELECT count(*) FROM store) AS article_count,
  concat('[', coalesce(CAST(day AS VARCHAR), 'None'), '] ', headline[:40], '... (Q:', quality_score, ')') AS line
FROM store ORDER BY created DESC, content_hash LIMIT 5""")
def status_report(spark, folder):
    return S.status_lines(tables(spark, folder)[0]).select("content_hash", "article_count", "line")


@add("s10_preview", f"WITH {V.ARTICLES} SELECT seq, headline[:60] AS headline_start FROM art ORDER BY seq LIMIT 5")
def preview(spark, folder):
    return A.sample_headlines(V.articles(spark, folder), 5, 60)


# --- changes --------------------------------------------------------------------------------

def doomed(spark, articles):
    """Hashes to delete: those of the negative articles, and one nobody has."""
    unknown = spark.range(1).select(F.lit("unknown").alias("content_hash"))
    return articles.filter(F.col("sentiment") == "利弊").select("content_hash").unionByName(unknown)


@add("r9_delete_by_hash", f"{STORE} SELECT content_hash, quality_score FROM store WHERE sentiment <> '利弊'")
def delete(spark, folder):
    before = tables(spark, folder)
    articles, _ = S.delete_by_hash(*before, doomed(spark, before[0]))
    return articles.select("content_hash", F.col("quality_score").cast("long").alias("quality_score"))


@add("r9_delete_cascade", f"""{STORE}, l AS (SELECT content_hash, string_split(factors, ',') AS f FROM store
  WHERE sentiment <> '利弊') SELECT content_hash, unnest(f) AS factor_name FROM l""")
def delete_cascade(spark, folder):
    before = tables(spark, folder)
    _, factors = S.delete_by_hash(*before, doomed(spark, before[0]))
    return factors.select("content_hash", "factor_name")


@add("r9_deletion_report", f"""{STORE} SELECT content_hash, true AS deleted FROM store WHERE sentiment = '利弊'
UNION ALL SELECT 'unknown', false""")
def deletion_report(spark, folder):
    articles, _ = tables(spark, folder)
    return S.deletion_report(articles, doomed(spark, articles))


@add("r11_upsert", f"""{STORE} SELECT content_hash, CASE WHEN sentiment = '利弊' THEN '利好' ELSE sentiment END AS sentiment,
  created AS created_second, CASE WHEN sentiment = '利弊' THEN 200000 ELSE created END AS updated_second FROM store""")
def upsert(spark, folder):
    articles, _ = tables(spark, folder)
    changes = articles.filter(F.col("sentiment") == "利弊").withColumn("sentiment", F.lit("利好"))
    after = S.upsert(articles, changes, F.timestamp_seconds(F.lit(200000)))
    return after.select("content_hash", "sentiment",
                        F.unix_timestamp("created_at").alias("created_second"),
                        F.unix_timestamp("updated_at").alias("updated_second"))


# --- files ----------------------------------------------------------------------------------

FLAT = """content_hash, date, headline, article_url, source_url, content_length, sentence_count,
  tech_keyword_count, quality_score, factors, sentiment, summary, relevant, processing_status"""


def _flat(rows):
    return rows.select(
        "content_hash", "date", "headline", "article_url", "source_url",
        *[F.col(c).cast("long").alias(c) for c in (
            "content_length", "sentence_count", "tech_keyword_count", "quality_score")],
        _factors(), "sentiment", "summary", "relevant", "processing_status")


@add("s1_raw_scan", f"WITH {V.ARTICLES} SELECT date, headline, article_url, source_url, md5(content) AS content_md5 FROM art")
def raw_scan(spark, folder):
    path = scratch_path(spark, "raw")
    V.articles(spark, folder).drop("seq").write.json(path)
    return A.read_raw(spark, path, lines=True).select(
        "date", "headline", "article_url", "source_url", F.md5("content").alias("content_md5"))


@add("s2_processed_scan", f"{PROCESSED} SELECT {FLAT} FROM processed")
@add("s3_processed_sink", f"{PROCESSED} SELECT {FLAT} FROM processed")
def processed_sink(spark, folder):
    path = scratch_path(spark, "processed")
    A.write_processed(processed(spark, folder), path)
    return _flat(A.read_processed(spark, path, lines=True))


@add("s4_numbered_sink", f"""WITH {V.ARTICLES}, runs AS (SELECT unnest([1, 2]) AS run_id)
SELECT run_id, count(*) AS articles FROM art, runs GROUP BY 1""")
def numbered_sink(spark, folder):
    root = scratch_path(spark, "runs")
    for _ in range(2):
        A.append_numbered(V.articles(spark, folder), root)
    return A.read_numbered(spark, root).groupBy(F.col("run_id").cast("long").alias("run_id")).agg(
        F.count(F.lit(1)).alias("articles"))


@add("s5_timestamped_output", f"WITH {V.ARTICLES} SELECT count(*) AS articles, true AS well_named FROM art")
def timestamped_output(spark, folder):
    path = A.timestamped_path(spark, scratch_path(spark, "stamped"), "articles")
    V.articles(spark, folder).write.parquet(path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("articles")).withColumn(
        "well_named", F.rlike(F.lit(path), F.lit(r"/articles_\d{8}_\d{6}$")))


def _by_source(spark, folder):
    """Processed articles written as one set of files per source site."""
    root = scratch_path(spark, "sources")
    rows = processed(spark, folder)
    rows.withColumn("site", F.regexp_extract("source_url", "//([^.]+)", 1)).drop("seq").write.partitionBy(
        "site").json(root)
    return root


BY_SITE = f"""{PROCESSED}, own AS (SELECT regexp_extract(source_url, '//([^.]+)', 1) AS site, content_hash, date, headline FROM processed),
judged AS (SELECT site, date <> '' AS good FROM own)"""


def _verdicts(spark, folder):
    rows = A.read_processed(spark, _by_source(spark, folder), lines=True).withColumn(
        "file", F.regexp_extract("file", "site=([^/]+)/", 1))
    return M.file_verdicts(S.check(rows))


@add("s7_rows_per_file", f"{BY_SITE} SELECT site AS file, count(*) AS articles FROM own GROUP BY 1")
def rows_per_file(spark, folder):
    rows = A.read_processed(spark, _by_source(spark, folder), lines=True).withColumn(
        "file", F.regexp_extract("file", "site=([^/]+)/", 1))
    return A.rows_per_file(rows)


@add("r10_migration_verdicts", f"""{BY_SITE} SELECT site AS file, count(*) AS articles, count(*) FILTER (good) AS inserted,
  count(*) FILTER (NOT good) AS failed, count(*) FILTER (NOT good) = 0 AS success FROM judged GROUP BY 1""")
def migration_verdicts(spark, folder):
    return _verdicts(spark, folder)


@add("s7_migrated_total", f"""{BY_SITE}, f AS (SELECT site, count(*) AS n, bool_and(good) AS ok FROM judged GROUP BY 1)
SELECT CAST(coalesce(sum(n) FILTER (ok), 0) AS BIGINT) AS migrated FROM f""")
def migrated_total(spark, folder):
    return M.migrated_total(_verdicts(spark, folder))


@add("s8_store_append", f"""{STORE} SELECT content_hash, CAST(day AS VARCHAR) AS date, headline, quality_score, factors,
  processing_status FROM store WHERE date <> ''""")
def store_append(spark, folder):
    store = ArticleStore(spark, scratch_path(spark, "store"))
    rows = processed(spark, folder)
    store.insert(rows.filter(F.col("quality_score") >= 9))
    store.insert(rows)
    return _view(store.rows(), _factors(), "processing_status")


@add("s8_store_rewrite", f"""{STORE} SELECT content_hash, CAST(day AS VARCHAR) AS date, headline, quality_score, factors
FROM store WHERE date <> '' AND sentiment <> '利弊'""")
def store_rewrite(spark, folder):
    store = ArticleStore(spark, scratch_path(spark, "store"))
    rows = processed(spark, folder)
    store.insert(rows)
    store.delete(doomed(spark, rows))
    return _view(S.with_factors(store.articles(), store.factors()), _factors())


@add("e1_incremental_runs", f"""{PROCESSED}, one AS (SELECT content_hash, quality_score FROM processed)
SELECT content_hash, quality_score FROM one""")
def incremental_runs(spark, folder):
    """The articles arrive twice, by the file stream; each is stored once."""
    arriving, root = scratch_path(spark, "arriving"), scratch_path(spark, "store")
    store = ArticleStore(spark, root)
    replies = V.responses(spark, folder)

    fields = ("date", "headline", "content", "article_url", "source_url")
    identity = F.md5(F.concat_ws("|", *fields))
    order = landed(V.articles(spark, folder).groupBy(identity.alias("_id")).agg(F.min("seq").alias("seq")), "order")

    def judge(rows):
        """Texts stay where they are read; their measures get the numbers. Rows of one identity are equal."""
        narrow = P.measured(rows.withColumn("_id", identity), PROFILE_A, V.KEYWORDS, columns=(*P.NARROW, *P.METRICS, "_id"))
        numbered = narrow.drop("seq").dropDuplicates(["_id"]).join(order, "_id").drop("_id")
        return P.annotated(numbered, replies, PROFILE_A)

    for _ in range(2):
        V.articles(spark, folder).drop("seq").write.mode("append").json(arriving)
        query = ingest(raw_stream(spark, arriving, lines=True), store, root + "-checkpoint", judge)
        query.awaitTermination()
    return store.articles().select("content_hash", F.col("quality_score").cast("long").alias("quality_score"))
