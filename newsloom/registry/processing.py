"""Queries of the processing flow: predicates, dedup, quality, annotation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from newsloom.functions import dates as DT
from newsloom.functions import text as T
from newsloom.operators import annotate as N
from newsloom.operators import dedup as D
from newsloom.operators import quality as Q
from newsloom.plans import process as P
from newsloom.profiles import PROFILE_A, PROFILE_B
from newsloom.registry import views as V
from newsloom.registry.base import Registry

REGISTRY = Registry()
add = REGISTRY.add
BOTH = (("a", PROFILE_A), ("b", PROFILE_B))


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


def _joined(name="quality_factors", alias="factors"):
    return F.concat_ws(",", name).alias(alias)


# --- predicates -----------------------------------------------------------------------------

def _usable_sql(minimum):
    return f"""WITH {V.ARTICLES} SELECT seq FROM art
WHERE length({V.sql_strip('content')}) >= {minimum} AND length({V.sql_strip('headline')}) > 0"""


@add("p1_usable_article", _usable_sql(200))
def usable(spark, folder):
    return V.articles(spark, folder).filter(Q.usable(F.col("content"), F.col("headline"))).select("seq")


@add("e3_minimum_length", _usable_sql(600))
def usable_longer(spark, folder):
    return V.articles(spark, folder).filter(
        Q.usable(F.col("content"), F.col("headline"), 600)).select("seq")


@add("p4_default_fill", f"""WITH {V.ARTICLES} SELECT seq, coalesce(nullif(date, ''), '') AS date,
coalesce(nullif(headline, ''), '') AS headline FROM art""")
def default_fill(spark, folder):
    missing = V.articles(spark, folder).select(
        "seq", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("date", "headline")])
    return missing.select("seq", *[T.or_empty(F.col(c)).alias(c) for c in ("date", "headline")])


@add("p7_empty_content_drop", f"WITH {V.ARTICLES} SELECT seq, length(content) AS chars FROM art WHERE content <> ''")
def empty_drop(spark, folder):
    return D.drop_empty_content(V.articles(spark, folder)).select(
        "seq", F.length("content").cast("long").alias("chars"))


@add("t_strip_and_cut", f"""WITH {V.ARTICLES} SELECT seq, {V.sql_strip('content')} AS stripped,
  {V.sql_collapse('content')} AS collapsed, headline[:50] AS cut FROM art""")
def strip_and_cut(spark, folder):
    content = F.col("content")
    return V.articles(spark, folder).select(
        "seq", T.strip(content).alias("stripped"), T.collapse(content).alias("collapsed"),
        T.preview(F.col("headline"), 50).alias("cut"))


# --- dedup ----------------------------------------------------------------------------------

@add("d1_content_hash_a", f"WITH {V.ARTICLES} SELECT seq, {V.sql_hash_a()} AS content_hash FROM art")
def hash_a(spark, folder):
    return D.hashed(V.articles(spark, folder), PROFILE_A).select("seq", "content_hash")


@add("d2_content_hash_b", f"WITH {V.ARTICLES} SELECT seq, {V.HASH_B} AS content_hash FROM art")
def hash_b(spark, folder):
    return D.hashed(V.articles(spark, folder), PROFILE_B).select("seq", "content_hash")


@add("d3_dedup_a", f"""WITH {V.ARTICLES} SELECT seq, headline, length(content) AS chars, {V.sql_hash_a()} AS content_hash
FROM art WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seq) = 1""")
def dedup_a(spark, folder):
    return D.unique_rows(V.articles(spark, folder), PROFILE_A, headline=F.col("headline"),
                         chars=F.length("content").cast("long")).select("seq", "headline", "chars", "content_hash")


@add("d4_dedup_b", f"""WITH {V.ARTICLES} SELECT seq, headline, length(content) AS chars FROM art
QUALIFY row_number() OVER (PARTITION BY {V.HASH_B} ORDER BY seq) = 1""")
def dedup_b(spark, folder):
    return D.unique_rows(V.articles(spark, folder), PROFILE_B, headline=F.col("headline"),
                         chars=F.length("content").cast("long")).drop("content_hash")


def _counts_sql(identity, drops):
    kept = "content <> ''" if drops else "true"
    return f"""WITH {V.ARTICLES}, h AS (SELECT {identity} AS k, {kept} AS kept FROM art)
SELECT count(*) AS loaded, count(*) FILTER (NOT kept) AS empty_dropped,
  count(DISTINCT k) FILTER (kept) AS unique_count,
  count(*) FILTER (kept) - count(DISTINCT k) FILTER (kept) AS duplicate_count FROM h"""


@add("d5_duplicate_counts_a", _counts_sql(V.sql_hash_a(), True))
def counts_a(spark, folder):
    return D.duplicate_counts(V.articles(spark, folder), PROFILE_A)


@add("d5_duplicate_counts_b", _counts_sql(V.HASH_B, False))
def counts_b(spark, folder):
    return D.duplicate_counts(V.articles(spark, folder), PROFILE_B)


def _report_sql(identity, kept):
    return f"""WITH {V.ARTICLES} SELECT seq, {identity} AS content_hash, headline[:50] AS headline_start
FROM art WHERE {kept} QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seq) > 1"""


@add("d6_duplicate_report_a", _report_sql(V.sql_hash_a(), "content <> ''"))
def report_a(spark, folder):
    return D.duplicate_report(V.articles(spark, folder), PROFILE_A)


@add("d6_duplicate_report_b", _report_sql(V.HASH_B, "true"))
def report_b(spark, folder):
    return D.duplicate_report(V.articles(spark, folder), PROFILE_B)


def _by_key_sql(key):
    return f"""WITH {V.ARTICLES} SELECT seq, headline, article_url FROM art
QUALIFY coalesce({key}, '') = '' OR row_number() OVER (PARTITION BY {key} ORDER BY seq) = 1"""


@add("e2_dedup_by_url", _by_key_sql("article_url"))
def dedup_by_url(spark, folder):
    return D.unique_rows_by(V.articles(spark, folder), F.col("article_url"), headline=F.col("headline"),
                            article_url=F.col("article_url"))


@add("e2_dedup_by_title", _by_key_sql("headline"))
def dedup_by_title(spark, folder):
    return D.unique_rows_by(V.articles(spark, folder), F.col("headline"), headline=F.col("headline"),
                            article_url=F.col("article_url"))


# --- quality --------------------------------------------------------------------------------

def _register_quality(tag, profile):
    base = f"WITH {V.ARTICLES}, {V.sql_scored(profile)}"

    def band_query(name, value, bands, column=None):
        sql = f"""{base} SELECT seq, {value} AS amount, {V.sql_band(value, bands, 1)} AS points,
  {V.sql_band(value, bands, 2)} AS label FROM scored"""

        @add(name, sql)
        def query(spark, folder, value=column or value, bands=bands):
            rows = Q.measure(V.articles(spark, folder), profile, V.KEYWORDS).drop("content")
            amount = F.expr(value)
            return rows.select(
                "seq", amount.cast("long").alias("amount"),
                Q._band(amount, bands, 1).cast("long").alias("points"),
                Q._band(amount, bands, 2).alias("label"))

    band_query(f"q1_length_band_{tag}", "content_length", profile.length_bands)
    band_query(f"q2_sentence_band_{tag}", "sentence_count", profile.sentence_bands)
    band_query(f"q3_keyword_band_{tag}", "tech_keyword_count", profile.keyword_bands)
    if profile.headline_bands:
        band_query(f"q5_headline_points_{tag}", "length(headline)", profile.headline_bands)

    @add(f"q6_factor_list_{tag}", f"{base} SELECT seq, factors FROM scored")
    def factor_list(spark, folder):
        return Q.assess(V.articles(spark, folder), profile, V.KEYWORDS).select("seq", _joined())

    @add(f"q7_total_score_{tag}", f"""{base} SELECT seq, content_length, sentence_count,
  tech_keyword_count, quality_score FROM scored""")
    def total_score(spark, folder):
        return Q.assess(V.articles(spark, folder), profile, V.KEYWORDS).select("seq", *_long(
            "content_length", "sentence_count", "tech_keyword_count", "quality_score"))

    @add(f"p6_quality_gate_{tag}", f"""{base} SELECT seq, quality_score FROM scored WHERE quality_score >= 3""")
    def gate(spark, folder):
        return Q.assess(V.articles(spark, folder), profile, V.KEYWORDS).filter(
            Q.passes_gate(profile)).select("seq", *_long("quality_score"))


for _tag, _profile in BOTH:
    _register_quality(_tag, _profile)

_BASE_A = f"WITH {V.ARTICLES}, {V.sql_scored(PROFILE_A)}"


@add("q4_metadata_points_a", f"{_BASE_A} SELECT seq, date <> '' AS has_date, article_url <> '' AS has_url FROM scored")
def metadata(spark, folder):
    return Q.with_flags(V.articles(spark, folder)).select("seq", "has_date", "has_url")


@add("q8_quality_level_a", f"""{_BASE_A} SELECT CASE WHEN quality_score >= 7 THEN 'high'
  WHEN quality_score >= 4 THEN 'medium' ELSE 'poor' END AS level, count(*) AS articles FROM scored GROUP BY 1""")
def level(spark, folder):
    return Q.assess(V.articles(spark, folder), PROFILE_A, V.KEYWORDS).groupBy(
        Q.quality_level(F.col("quality_score")).alias("level")).agg(F.count(F.lit(1)).alias("articles"))


# --- annotation -----------------------------------------------------------------------------

def _request_sql(fields):
    return f"""WITH {V.ARTICLES} SELECT seq, md5(json_object({fields})::VARCHAR) AS request_md5 FROM art"""


@add("n1_request_a", _request_sql(f"""'model', 'm1', 'messages', [json_object('role', 'system', 'content',
  '{N.SYSTEM_PROMPT.replace("'", "''")}'), json_object('role', 'user', 'content', content)],
  'temperature', 0.2, 'preset', true, 'session_id', 's1'"""))
def request_a(spark, folder):
    body = N.request_body(F.col("content"), "m1", PROFILE_A, "s1")
    return V.articles(spark, folder).select("seq", F.md5(body).alias("request_md5"))


@add("n2_request_b", _request_sql(f"""'model', 'm1', 'messages', [json_object('role', 'user', 'content',
  concat('{N.TEMPLATE_HEAD}', content, '{N.TEMPLATE_TAIL}'))], 'max_tokens', 500, 'temperature', 0.3"""))
def request_b(spark, folder):
    body = N.request_body(F.col("content"), "m1", PROFILE_B)
    return V.articles(spark, folder).select("seq", F.md5(body).alias("request_md5"))


_DECODED = ("seq", "attempt", "kind", "sentiment", "summary", "relevant", "error_text")
_KIND_A = """CASE WHEN shape IN (0, 8) THEN 'next' WHEN shape IN (4, 6) THEN 'stop'
  WHEN shape IN (2, 7) THEN 'next' WHEN closed THEN 'ok' ELSE 'next' END"""
_KIND_B = """CASE WHEN shape IN (0, 4, 6, 8) THEN 'next' WHEN shape = 3 THEN 'error'
  WHEN shape IN (1, 2, 5, 7) THEN 'stop' ELSE 'ok' END"""


def _decode_sql(kind, tail="SELECT * FROM decoded"):
    ok = "CASE WHEN kind = 'ok' THEN {0} END AS {0}"
    return f"""WITH {V.ANSWERS}, {V.ATTEMPTS}, k AS (SELECT *, {kind} AS kind FROM att),
decoded AS (SELECT seq, CAST(attempt AS BIGINT) AS attempt, kind, {', '.join(ok.format(c) for c in N.REPLY_KEYS)},
  CASE WHEN kind = 'error' THEN '''choices''' END AS error_text FROM k)
{tail}"""


def _fold_sql(kind, limit):
    return _decode_sql(kind, f"""SELECT seq, kind AS outcome, sentiment AS reply_sentiment,
  summary AS reply_summary, relevant AS reply_relevant, error_text FROM decoded
WHERE attempt <= {limit} AND kind <> 'next'
QUALIFY row_number() OVER (PARTITION BY seq ORDER BY attempt) = 1""")


def _register_replies(tag, profile, kind, limits):
    @add(f"n{3 if tag == 'a' else 4}_decode_{tag}", _decode_sql(kind))
    def decode(spark, folder):
        return N.decode_replies(V.attempts(spark, folder), profile).select(
            *_DECODED[:1], F.col("attempt").cast("long").alias("attempt"), *_DECODED[2:])

    for limit in limits:
        @add(f"n6_fold_attempts_{tag}{limit}", _fold_sql(kind, limit))
        def fold(spark, folder, limit=limit):
            return N.replies(V.attempts(spark, folder), profile, limit)


_register_replies("a", PROFILE_A, _KIND_A, (1, 3))
_register_replies("b", PROFILE_B, _KIND_B, (2, 3))


@add("n5_validate_a", f"""WITH {V.ANSWERS} SELECT seq, sentiment IN ('利好', '中立', '利弊') AS valid FROM ans""")
def validate_a(spark, folder):
    reply = F.struct("sentiment", "summary", "relevant")
    return V.answers(spark, folder).select("seq", N.valid_closed_sets(reply).alias("valid"))


@add("n5_validate_b", f"""WITH {V.ANSWERS} SELECT seq, seq % 4 <> 0 AS valid FROM ans""")
def validate_b(spark, folder):
    full = F.to_json(F.struct("sentiment", "summary", "relevant"))
    lacking = F.to_json(F.struct("sentiment", "relevant"))
    return V.answers(spark, folder).select(
        "seq", N.has_reply_keys(F.when(F.col("seq") % 4 == 0, lacking).otherwise(full)).alias("valid"))


def _processed_sql(profile):
    identity = "content_hash, " if profile.keeps_hash else ""
    return f"""WITH {V.sql_processed(profile)} SELECT seq, {identity}date, headline, article_url, source_url,
  content_length, sentence_count, tech_keyword_count, quality_score, factors,
  sentiment, summary, relevant, processing_status FROM processed"""


def _flat(processed, profile):
    identity = ["content_hash"] if profile.keeps_hash else []
    return processed.select(
        "seq", *identity, "date", "headline", "article_url", "source_url",
        *_long("content_length", "sentence_count", "tech_keyword_count", "quality_score"),
        _joined(), "sentiment", "summary", "relevant", "processing_status")


for _tag, _profile in BOTH:
    @add(f"n8_route_status_{_tag}", _processed_sql(_profile))
    def route_status(spark, folder, profile=_profile):
        return _flat(P.process(
            V.articles(spark, folder), V.responses(spark, folder), profile, V.KEYWORDS), profile)

    _loaded = "0" if not _profile.drops_empty_content else "count(*) FILTER (content = '')"

    @add(f"n10_run_summary_{_tag}", f"""WITH {V.sql_processed(_profile)},
loads AS (SELECT count(*) AS loaded, {_loaded} AS empty_dropped FROM art)
SELECT any_value(loaded) AS loaded, any_value(empty_dropped) AS empty_dropped,
  any_value(loaded) - any_value(empty_dropped) - count(*) AS duplicate_count, count(*) AS unique_count,
  count(*) FILTER (processing_status = 'success') AS success_count,
  count(*) FILTER (processing_status = 'failed') AS failed_count,
  count(*) FILTER (processing_status = 'low_quality') AS low_quality_count,
  count(*) FILTER (relevant = '是') AS relevant_count, round(avg(quality_score), 6) AS avg_quality
FROM processed, loads""")
    def run_summary(spark, folder, profile=_profile):
        summary = P.run_summary(
            V.articles(spark, folder), V.responses(spark, folder), profile, V.KEYWORDS)
        return summary.withColumn("avg_quality", F.round("avg_quality", 6))


_ERROR_SQL = f"""WITH {V.ARTICLES}, {V.ANSWERS}, {V.ATTEMPTS}, {V.sql_scored(PROFILE_B)}, {V.sql_unique(PROFILE_B)},
k AS (SELECT *, {_KIND_B} AS kind FROM att),
settled AS (SELECT * FROM k WHERE attempt <= 2 AND kind <> 'next'
  QUALIFY row_number() OVER (PARTITION BY seq ORDER BY attempt) = 1),
routed AS (SELECT u.seq, u.quality_score, CASE WHEN u.content = '' THEN 'no_content'
    WHEN u.quality_score < 3 THEN 'low_quality' WHEN s.kind = 'ok' THEN 'success'
    WHEN s.kind = 'error' THEN 'error' ELSE 'failed' END AS processing_status
  FROM uniq u LEFT JOIN settled s ON u.seq = s.seq)
SELECT seq, CASE WHEN processing_status <> 'error' THEN quality_score ELSE -1 END AS quality_score,
  processing_status, CASE WHEN processing_status = 'error' THEN '处理错误: ''choices''' ELSE '' END AS problem
FROM routed"""


@add("n9_error_isolation_b", _ERROR_SQL)
def error_isolation(spark, folder):
    rows = P.process(V.articles(spark, folder), V.attempts(spark, folder), PROFILE_B, V.KEYWORDS)
    return rows.select(
        "seq", F.coalesce(F.col("quality_score"), F.lit(-1)).cast("long").alias("quality_score"),
        "processing_status",
        F.when(F.col("processing_status") == "error", F.col("summary")).otherwise("").alias("problem"))


def length_scorer(texts: pd.Series) -> pd.DataFrame:
    """A stand-in for a model: judges by length."""
    long = texts.str.len() >= 500
    return pd.DataFrame({
        "sentiment": long.map({True: "利好", False: "中立"}),
        "summary": texts.str.len().astype(str),
        "relevant": long.map({True: "是", False: "否"}),
    })


@add("n7_batch_annotate_a", f"""WITH {V.sql_processed(PROFILE_A)} SELECT seq, quality_score,
  CASE WHEN quality_score < 3 THEN '中立' WHEN content_length >= 500 THEN '利好' ELSE '中立' END AS sentiment,
  CASE WHEN quality_score < 3 THEN '文章质量过低，跳过分析' ELSE CAST(content_length AS VARCHAR) END AS summary,
  CASE WHEN quality_score >= 3 AND content_length >= 500 THEN '是' ELSE '否' END AS relevant
FROM processed""")
def batch_annotate(spark, folder):
    rows = P.process_with_scorer(V.articles(spark, folder), length_scorer, PROFILE_A, V.KEYWORDS)
    return rows.select("seq", *_long("quality_score"), "sentiment", "summary", "relevant")


_LABEL_SQL = "CASE {0} WHEN '利好' THEN 'positive' WHEN '中立' THEN 'neutral' WHEN '利弊' THEN 'negative' " \
             "WHEN '是' THEN 'yes' WHEN '否' THEN 'no' ELSE {0} END"


@add("e4_english_labels", f"""WITH {V.ANSWERS} SELECT seq, {_LABEL_SQL.format('sentiment')} AS sentiment,
{_LABEL_SQL.format('relevant')} AS relevant FROM ans""")
def english_labels(spark, folder):
    return V.answers(spark, folder).select(
        "seq", N.english_label(F.col("sentiment")).alias("sentiment"),
        N.english_label(F.col("relevant")).alias("relevant"))


@add("x4_date_normalisation", f"""WITH {V.ARTICLES}, d AS (SELECT seq, CASE seq % 4
  WHEN 0 THEN date WHEN 1 THEN concat(date[6:7], '.', date[9:10], '.', date[3:4])
  WHEN 2 THEN concat(date[6:7], '.', date[9:10], '.', date[1:4]) ELSE concat('on ', date) END AS raw FROM art)
SELECT seq, CASE WHEN regexp_matches(raw, '^[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{2}}$') THEN
  concat(raw[1:6], '20', raw[7:8])
  WHEN regexp_matches(raw, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN
  concat(raw[6:7], '.', raw[9:10], '.', raw[1:4]) ELSE raw END AS date FROM d""")
def date_normalisation(spark, folder):
    rows = V.articles(spark, folder)
    date = F.col("date")
    part = lambda a, n: F.substring(date, a, n)
    dot = F.lit(".")
    raw = (
        F.when(F.col("seq") % 4 == 0, date)
        .when(F.col("seq") % 4 == 1, F.concat(part(6, 2), dot, part(9, 2), dot, part(3, 2)))
        .when(F.col("seq") % 4 == 2, F.concat(part(6, 2), dot, part(9, 2), dot, part(1, 4)))
        .otherwise(F.concat(F.lit("on "), date)))
    return rows.select("seq", DT.card_date(raw).alias("date"))
