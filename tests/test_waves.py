"""Waves of links: what a crawl extracts, and that it finds what extracting everything finds."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import crawl as C
from newsloom.operators import extract as X
from newsloom.operators import links as L
from newsloom.plans import crawl as PC

GOOD = "<h1>T</h1><article><p>" + "A sentence that is long enough to count. " * 8 + "</p></article>"
POOR = "<h1>T</h1><article><p>short</p></article>"


def web(spark, sites):
    """``sites`` maps a site to the pages behind its links, in order."""
    rows = []
    for site, bodies in sites.items():
        rows.append((site, "<body>" + "".join(f'<a href="{site}news/{i}">x</a>' for i in range(len(bodies))) + "</body>"))
        rows += [(f"{site}news/{i}", body) for i, body in enumerate(bodies) if body is not None]
    return spark.createDataFrame(rows, "url string, html string")


def counted(spark, monkeypatch):
    """Counts the pages that the extractors are given."""
    seen = spark.sparkContext.accumulator(0)
    for name in ("extract_main", "extract_fallback", "extract_rendered"):
        own = getattr(X, name)

        def counting(pages, own=own):
            seen.add(pages.count())
            return own(pages)

        monkeypatch.setattr(X, name, counting)
    return seen


# The second site's first nine pages are all that the first extractor may look at; the next one goes on for two waves.
@pytest.mark.parametrize(("bodies", "most"), [
    ([GOOD] * 10_000, 9), ([POOR] * 9 + [GOOD] * 9_991, 9 + 36), ([None] * 40 + [GOOD] * 9_960, 104)])
def test_a_filled_site_is_left_alone(spark, monkeypatch, bodies, most):
    site = "https://a.example.com/"
    pages = web(spark, {site: bodies})
    sites = spark.createDataFrame([(site, 3)], "source_url string, quota int")
    seen = counted(spark, monkeypatch)
    found = PC.crawl(sites, pages).collect()
    assert len(found) == 3 and 0 < seen.value <= most


def test_waves_find_what_all_pages_give(spark):
    rng = random.Random(4)
    sites = {f"https://s{i}.example.com/": [rng.choice([GOOD, POOR, None, "<h1>T</h1>"]) for _ in range(rng.randrange(0, 90))]
             for i in range(12)}
    pages = web(spark, sites)
    asked = spark.createDataFrame([(s, rng.randrange(1, 5)) for s in sites], "source_url string, quota int")
    home = PC.site_pages(asked, pages)
    everything = C.cascade({
        "main": X.extract_main(PC.linked_pages(L.static_links(home), pages)),
        "fallback": X.extract_fallback(PC.linked_pages(L.fallback_links(home), pages)),
        "rendered": X.extract_rendered(PC.linked_pages(L.rendered_links(home), pages))}, asked)

    def plain(frame):
        return sorted((r.source_url, r.method, r.article_url) for r in frame.select("source_url", "method", "article_url").collect())

    assert plain(PC.crawl(asked, pages)) == plain(everything)


def test_no_sites(spark):
    pages = web(spark, {"https://a.example.com/": [GOOD]})
    none = spark.createDataFrame([], "source_url string, quota int")
    assert PC.crawl(none, pages).count() == 0
    assert PC.crawl(none.unionByName(spark.range(1).select(F.lit("x").alias("source_url"), F.lit(0).alias("quota"))), pages).count() == 0


def test_a_link_leads_to_one_page(spark):
    """Two pages were stored under one URL: the later one answers, once; told apart by site, each its own site's link."""
    a, b, url = "https://a.example.com/", "https://a.example.com/b", "https://a.example.com/news/0"
    link = f'<body><a href="{url}">x</a></body>'
    # No extractor fills a quota of four, so each brings what it finds.
    sites = spark.createDataFrame([(a, 4), (b, 4)], "source_url string, quota int")
    rows = [(a, a, 0, link), (b, b, 0, link), (url, a, 1, GOOD.replace("T<", "old<")), (url, b, 2, GOOD.replace("T<", "new<"))]
    pages = spark.createDataFrame(rows, "url string, source_url string, seq long, html string")

    def found(pages):
        return sorted((r.source_url, r.method, r.headline) for r in PC.crawl(sites, pages).collect())

    def listed(first, second):
        return sorted((s, m, h) for s, h in ((a, first), (b, second)) for m in C.METHODS)

    assert found(pages.drop("source_url")) == listed("new", "new")
    assert found(pages) == listed("old", "new")
