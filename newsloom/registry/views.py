"""The given tables seen as articles, replies and pages, in Spark and in the checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import WHITESPACE
from newsloom.functions.urls import netloc

# The default keywords never occur in the invented prose; these do ("AI" cannot match by design).
KEYWORDS = ("tion", "ing", "the", "and", "for", "eau", "ment", "sch", "ción", "AI")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    seq = F.col("doc_id")
    site = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (seq % 365).cast("int")).cast("string")
    return docs.select(
        seq.alias("seq"),
        F.when(seq % 7 == 0, "").otherwise(day).alias("date"),
        F.when(seq % 13 == 0, "").otherwise(F.split_part("text", F.lit("\n"), F.lit(1))).alias("headline"),
        F.when(seq % 17 == 0, "").otherwise(F.col("text")).alias("content"),
        F.when(seq % 11 == 0, "").otherwise(
            F.concat(site, F.lit("/news/"), seq.cast("string"))).alias("article_url"),
        site.alias("source_url"),
    )


ARTICLES = """art AS (
  SELECT doc_id AS seq,
    CASE WHEN doc_id % 7 = 0 THEN '' ELSE
      CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS VARCHAR) END AS date,
    CASE WHEN doc_id % 13 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS headline,
    CASE WHEN doc_id % 17 = 0 THEN '' ELSE text END AS content,
    CASE WHEN doc_id % 11 = 0 THEN '' ELSE
      concat('https://', source, '.example.com/news/', doc_id) END AS article_url,
    concat('https://', source, '.example.com') AS source_url
  FROM documents)"""


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """One reply per labelled document: ``seq, sentiment, summary, relevant``."""
    labels = table(spark, folder, "labels")
    seq = F.col("doc_id")
    sentiment = (
        F.when(seq % 10 == 3, "positive").when(F.col("toxic") == 1, "利弊")
        .when(F.col("quality") == 1, "利好").otherwise("中立"))
    return labels.select(
        seq.alias("seq"), sentiment.alias("sentiment"),
        F.concat(F.lit("摘要 "), seq.cast("string")).alias("summary"),
        F.when(F.col("quality") == 1, "是").otherwise("否").alias("relevant"))


ANSWERS = """ans AS (
  SELECT doc_id AS seq,
    CASE WHEN doc_id % 10 = 3 THEN 'positive' WHEN toxic = 1 THEN '利弊'
      WHEN quality = 1 THEN '利好' ELSE '中立' END AS sentiment,
    concat('摘要 ', doc_id) AS summary,
    CASE WHEN quality = 1 THEN '是' ELSE '否' END AS relevant
  FROM labels)"""


def envelope(text):
    message = F.struct(F.lit("assistant").alias("role"), text.alias("content"))
    return F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """The replies as model responses, one attempt each."""
    reply = F.to_json(F.struct("sentiment", "summary", "relevant"))
    return answers(spark, folder).select(
        "seq", F.lit(1).alias("attempt"), F.lit(200).alias("status"), envelope(reply).alias("body"))


SHAPES = 10


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Three attempts per labelled document, in the shapes responses come in."""
    rows = answers(spark, folder).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(3))))
    shape = (F.col("seq") * 7 + F.col("attempt") * 3) % SHAPES
    reply = F.to_json(F.struct("sentiment", "summary", "relevant"))
    body = (
        F.when(shape == 0, F.lit("gateway"))
        .when(shape == 1, envelope(F.concat(F.lit("```json\n"), reply, F.lit("\n```"))))
        .when(shape == 2, envelope(F.concat(reply, reply)))
        .when(shape == 3, reply)
        .when(shape == 4, F.lit(""))
        .when(shape == 5, envelope(F.concat(reply, F.lit(" junk"))))
        .when(shape == 6, F.lit("not json"))
        .when(shape == 7, envelope(F.to_json(F.struct("sentiment", "summary"))))
        .otherwise(envelope(reply)))
    status = F.when(shape == 0, 502).when(shape == 8, F.lit(None)).otherwise(200)
    return rows.select("seq", "attempt", status.cast("int").alias("status"), body.alias("body"))


ATTEMPTS = """att AS (
  SELECT ans.*, a.attempt, (seq * 7 + a.attempt * 3) % 10 AS shape,
    (sentiment IN ('利好', '中立', '利弊')) AS closed
  FROM ans, (SELECT unnest([1, 2, 3]) AS attempt) a)"""


# Pages get links of every kind: absolute, on teasers, as listing links, as page anchors.
def pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pages")
    kind, html = F.col("page_id") % 5, F.col("html")

    def swap(old: str, new) -> F.Column:
        return F.replace(html, F.lit(old), new if not isinstance(new, str) else F.lit(new))

    absolute = F.concat(F.lit('<a href="https://'), netloc(F.col("url")), F.lit("/news/"))
    # A tag whose quote never closes is no link and holds none, so the checking SQL does not have it at all.
    stray = F.when(F.contains(html, F.lit("'")), "").otherwise("<div class=\"teaser\"><a href='/bad>b</a></div>")
    return rows.select(
        "page_id", "url",
        F.when(kind == 1, swap('<a href="/', absolute))
        .when(kind == 2, F.concat(stray, swap('<li><a href="/', '<li class="card-title teaser"><a href="/')))
        .when(kind == 3, swap('<a href="/', '<a class="article-links" href="/story/'))
        .when(kind == 4, swap('<a href="/', '<a href="#/'))
        .otherwise(html).alias("html"))


NETLOC = r"regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)"
PAGES = f"""pg AS (
  SELECT page_id, url,
    CASE page_id % 5
      WHEN 1 THEN replace(html, '<a href="/', concat('<a href="https://', {NETLOC.format('url')}, '/news/'))
      WHEN 2 THEN replace(html, '<li><a href="/', '<li class="card-title teaser"><a href="/')
      WHEN 3 THEN replace(html, '<a href="/', '<a class="article-links" href="/story/')
      WHEN 4 THEN replace(html, '<a href="/', '<a href="#/')
      ELSE html END AS html
  FROM pages)"""

# --- SQL pieces -----------------------------------------------------------------------------

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(text: str, extra: str = "") -> str:
    return f"trim({text}, '{WHITESPACE}{extra}')"


def sql_collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS}+', ' ', 'g'))"


def sql_hash_a(content: str = "content") -> str:
    return f"md5({sql_collapse(f'lower({content})')})"


HASH_B = "md5(concat(headline, '|', content))"


def sql_band(value: str, bands, pick: int) -> str:
    *better, floor = bands

    def literal(band):
        return str(band[pick]) if pick == 1 else f"'{band[pick]}'"

    return "CASE " + " ".join(
        f"WHEN {value} >= {b[0]} THEN {literal(b)}" for b in better) + f" ELSE {literal(floor)} END"


def sql_measures() -> str:
    hits = " + ".join(
        f"CAST(contains(lower(content), '{k}') AS INTEGER)" for k in KEYWORDS)
    return f"""length(content) AS content_length,
    len(list_filter(string_split(content, '.'), lambda s: {sql_strip('s')} <> '')) AS sentence_count,
    {hits} AS tech_keyword_count"""


def sql_scored(profile) -> str:
    """CTEs ``measured`` and ``scored`` over ``art``."""
    banded = [("content_length", profile.length_bands), ("sentence_count", profile.sentence_bands),
              ("tech_keyword_count", profile.keyword_bands)]
    if profile.headline_bands:
        banded.append(("length(headline)", profile.headline_bands))
    points = [f"({sql_band(v, b, 1)})" for v, b in banded]
    labels = [sql_band(v, b, 2) for v, b in banded]
    if profile.metadata_points:
        points += ["CAST(date <> '' AS INTEGER)", "CAST(article_url <> '' AS INTEGER)"]
        labels += ["CASE WHEN date <> '' THEN 'has_date' END",
                   "CASE WHEN article_url <> '' THEN 'has_url' END"]
    identity = HASH_B if profile.hash_covers_headline else sql_hash_a()
    return f"""measured AS (SELECT *, {identity} AS content_hash, {sql_measures()} FROM art),
scored AS (SELECT *, {' + '.join(points)} AS quality_score,
    concat_ws(',', {', '.join(labels)}) AS factors FROM measured)"""


def sql_unique(profile) -> str:
    keep = "WHERE content <> ''" if profile.drops_empty_content else ""
    return f"""uniq AS (SELECT * FROM scored {keep}
  QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seq) = 1)"""


def sql_processed(profile) -> str:
    """All CTEs up to ``processed``; every reply is one well-formed attempt."""
    valid = "a.seq IS NOT NULL" if profile.strict_reply else "a.sentiment IN ('利好', '中立', '利弊')"
    return f"""{ARTICLES}, {ANSWERS}, {sql_scored(profile)}, {sql_unique(profile)},
routed AS (SELECT u.*, a.sentiment AS a_sentiment, a.summary AS a_summary, a.relevant AS a_relevant,
    CASE WHEN content = '' THEN 'no_content' WHEN quality_score < 3 THEN 'low_quality'
      WHEN {valid} THEN 'success' ELSE 'failed' END AS processing_status
  FROM uniq u LEFT JOIN ans a ON u.seq = a.seq),
processed AS (SELECT * EXCLUDE (a_sentiment, a_summary, a_relevant),
    CASE WHEN processing_status = 'success' THEN a_sentiment ELSE '中立' END AS sentiment,
    CASE processing_status WHEN 'success' THEN a_summary WHEN 'no_content' THEN '无内容可供分析'
      WHEN 'low_quality' THEN '文章质量过低，跳过分析' ELSE 'LLM分析失败' END AS summary,
    CASE WHEN processing_status = 'success' THEN a_relevant ELSE '否' END AS relevant
  FROM routed)"""
