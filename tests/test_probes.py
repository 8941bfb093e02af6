"""Cases that once went wrong: quotas, keys, big pages, attributes, cards, replies, missing keys."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import html as H
from newsloom.operators import annotate as N
from newsloom.operators import crawl as C
from newsloom.operators import dedup as D
from newsloom.operators import extract as X
from newsloom.operators import links as L
from newsloom.operators import store as S
from newsloom.plans import crawl as PC
from newsloom.profiles import PROFILE_A
from newsloom.sources import articles as A
from newsloom.sources import pages as P

BODY = "A sentence that is long enough to be a part of an article. " * 5


def events(spark, *texts):
    return spark.createDataFrame(
        [("", f"h{i}", text, f"u{i}", "s", i) for i, text in enumerate(texts)],
        "date string, headline string, content string, article_url string, source_url string, pos int")


def test_a_site_requested_twice_gets_both_quotas(spark):
    found = {"main": events(spark, *[BODY] * 10)}
    twice = spark.createDataFrame([("s", 3), ("s", 3)], "source_url string, quota int")
    once = spark.createDataFrame([("s", 6)], "source_url string, quota int")
    assert C.cascade(found, twice).count() == C.cascade(found, once).count() == 6


def test_read_ahead_counts_pages_with_text(spark):
    sites = spark.createDataFrame([("s", 1)], "source_url string, quota int")
    found = {"main": events(spark, "", "", "", *[BODY] * 5)}
    assert [r.pos for r in C.cascade(found, sites).collect()] == [3]


def test_crawl_takes_the_first_extractor_past_empty_pages(spark):
    links = "".join(f'<a href="https://x.example.com/news/{i}">l</a>' for i in range(8))
    rows = [("https://x.example.com/", f"<body>{links}</body>")]
    rows += [(f"https://x.example.com/news/{i}", "" if i < 3 else f"<h1>T{i}</h1><article><p>{BODY}</p></article>") for i in range(8)]
    pages = spark.createDataFrame(rows, "url string, html string")
    sites = spark.createDataFrame([("https://x.example.com/", 1)], "source_url string, quota int")
    assert [(r.method, r.article_url) for r in PC.crawl(sites, pages).collect()] == [("main", "https://x.example.com/news/3")]


def test_row_numbers_do_not_depend_on_splits(spark, tmp_path):
    for part in range(3):
        lines = [f'{{"headline": "f{part} r{i}", "content": "{"x" * 200}"}}' for i in range(400)]
        (tmp_path / f"part{part}.json").write_text("\n".join(lines) + "\n")
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for size in ("16k", "128m"):
            spark.conf.set(key, size)
            rows = A.read_raw(spark, str(tmp_path), lines=True)
            assert rows.rdd.getNumPartitions() > 0
            found.append({r.headline: r.seq for r in rows.select("headline", "seq").collect()})
    finally:
        spark.conf.set(key, before)
    assert found[0] == found[1] == {f"f{p} r{i}": p * 400 + i for p in range(3) for i in range(400)}


@pytest.mark.parametrize("attributes", [100_000])
def test_a_tag_of_many_attributes(spark, attributes):
    tag = "<a " + " ".join(f'a{i}="v{i}"' for i in range(attributes)) + ' href="/x" class="teaser">'
    pages = spark.createDataFrame([("https://x.example.com/", f"{tag}t</a><p {'b=1 ' * attributes}>after</p>")], "url string, html string")
    row = L.anchors(pages).first()
    assert (row.href, row.link_class) == ("/x", "teaser")
    assert pages.select(H.clean_text(F.col("html")).alias("v")).first().v == "tafter"


def test_a_page_of_many_links(spark):
    page = '<div class="teaser">' + "".join(f'<a href="/news/{i}">x</a>' for i in range(8_000)) + "</div>"
    pages = spark.createDataFrame([("https://x.example.com/", page)], "url string, html string")
    assert L.static_links(pages).count() == 8_000


def test_many_cards_are_numbered_in_order(spark):
    page = "".join(f'<li class="card"><a class="article-links" href="/{i}">x</a></li>' for i in range(3_000))
    rows = L.card_links(spark.createDataFrame([("https://x.example.com", page)], "url string, html string"))
    got = [r.article_url for r in rows.orderBy("pos").collect()]
    assert got == [f"https://x.example.com/{i}" for i in range(3_000)]


def one(spark, page, expression):
    return spark.createDataFrame([(page,)], "html string").select(expression(F.col("html")).alias("v")).first().v


def test_attributes_are_found_at_their_place(spark):
    assert one(spark, '<div data-class="content">no</div><div class="content">yes</div>', X.content_fallback) == "yes"
    assert one(spark, '<meta data-name="pubdate" content="no"><meta name="pubdate" content="yes">', X.date_rendered) == "yes"
    pages = spark.createDataFrame([("https://x.example.com", '<a title="see href=/bad" href="/news/good">x</a>')], "url string, html string")
    assert L.anchors(pages).first().href == "/news/good"


def test_card_text_may_be_nested(spark):
    page = '<div class="card"><span class="card-info"><span>by X</span> 07.08.2025</span><a class="article-links" href="/a">x</a></div>'
    pages = spark.createDataFrame([("https://x.example.com", page)], "url string, html string")
    assert L.card_links(pages).first().listing_date == "07.08.2025"


@pytest.mark.parametrize(("body", "kind"), [
    ('{"choices": [{"message": {"content": "{\\"sentiment\\": \\"利好\\", \\"summary\\": 0, \\"relevant\\": \\"是\\"}"}}]}', "next"),
    ('{"choices": [{"message": {"content": "{\\"sentiment\\": \\"利好\\", \\"summary\\": [], \\"relevant\\": \\"是\\"}"}}]}', "next"),
    ('{"choices": [{"message": {"content": "{\\"sentiment\\": \\"利好\\", \\"summary\\": 5, \\"relevant\\": \\"是\\"}"}}]}', "stop"),
    ("17", "stop")])
def test_reply_kinds(spark, body, kind):
    rows = spark.createDataFrame([(1, 1, 200, body)], "seq long, attempt int, status int, body string")
    assert N.decode_replies(rows, PROFILE_A).first().kind == kind


def test_articles_without_a_key_are_nobodys_duplicates(spark):
    rows = spark.createDataFrame([(1, ""), (2, ""), (3, None), (4, "u"), (5, "u")], "seq long, article_url string")
    assert sorted(r.seq for r in D.deduplicate_by(rows, F.col("article_url")).collect()) == [1, 2, 3, 4]


def test_keep_first_neither_sorts_nor_aggregates_bodies(spark):
    rows = spark.range(100).select(
        F.col("id").alias("seq"), F.lit("h").alias("headline"), (F.col("id") % 7).cast("string").alias("content"))
    unique = D.deduplicate(rows, PROFILE_A)
    plan = unique._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert sorted(r.seq for r in unique.collect()) == list(range(7))


def test_a_missing_factor_breaks_a_rule(spark):
    rows = spark.createDataFrame([([None],)], "quality_factors array<string>").select(
        "*", *[F.lit("x").alias(c) for c in S.REQUIRED])
    assert "factor_missing" in rows.select(S.own_violations(rows).alias("v")).first().v


def test_snapshots_are_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "https://x.example.com/a", "old"), (2, "https://x.example.com/a", "new"), (3, "https://x.example.com/b", "b")],
        "seq long, url string, html string")
    P.write_snapshots(rows, str(tmp_path / "pages"))
    assert sorted((r.url[-1], r.html) for r in P.read_pages(spark, str(tmp_path / "pages")).collect()) == [("a", "new"), ("b", "b")]


def test_later_extractors_see_only_short_sites(spark):
    sites = spark.createDataFrame([("full", 1), ("short", 2)], "source_url string, quota int")
    asked = []

    def extractor(method):
        def extract(short):
            asked.append((method, sorted(r.source_url for r in short.collect())))
            rows = [("", "h", BODY, f"{s}/{method}", s, 1) for s in ("full", "short")]
            found = spark.createDataFrame(rows, "date string, headline string, content string, article_url string, source_url string, pos int")
            return found.join(short.select("source_url"), "source_url", "left_semi")
        return extract

    found = PC.fill_in_stages({m: extractor(m) for m in C.METHODS}, sites)
    assert asked == [("main", ["full", "short"]), ("fallback", ["short"]), ("rendered", [])]
    assert sorted(r.article_url for r in found.collect()) == ["full/main", "short/fallback", "short/main"]
