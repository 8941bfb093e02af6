"""From requested sites and stored pages to usable articles and crawl statistics.

The extractors run one after the other, as each is only needed for what the previous ones left open:
only links of sites that are still short are followed, and these in waves, so that a site's further pages
are not extracted once it is filled. What an extractor contributed is bounded by the quotas and is checkpointed,
so the next step reads it instead of extracting again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import crawl as C
from newsloom.operators import extract as X
from newsloom.operators import links as L
from newsloom.operators.quality import usable
from newsloom.operators.ranking import first_n_per_group
from newsloom.session import shared_folder
from newsloom.sources.landing import landed
from newsloom.sources.pages import last_pages

# Links that the first wave follows for each wanted article, and how much further each later wave reaches.
FIRST_WAVE, GROWTH = 3, 4


def site_pages(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """The requested sites' own pages, from which links are read."""
    wanted = sites.select(F.col("source_url").alias("url"))
    if "source_url" in pages.columns:
        pages = pages.filter(F.col("source_url") == F.col("url"))
    return pages.select("url", "html").join(wanted, "url", "left_semi")


def linked_pages(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Stored pages behind links, with the site and the position of the link.

    The link side is narrow; Spark prunes pages by a Bloom filter of the links before they move, or
    broadcasts the links when their measured size allows it. Pages with a ``source_url`` answer links of that site.
    """
    own = [c for c in ("source_url",) if c in pages.columns]
    target = pages.select(F.col("url").alias("article_url"), *own, "html")
    return links.join(target, ["article_url", *own]).withColumnRenamed("article_url", "url")


def in_waves(
    links: DataFrame, pages: DataFrame, sites: DataFrame, extract: Callable[[DataFrame], DataFrame],
    read_ahead: int | None = None,
) -> DataFrame:
    """Article records behind the links of each site, in the order of links.

    The first wave follows three links for each article that a site wants, every later one up to four times as many
    as all before. A site takes part until it has as many usable articles as it wants, or, with ``read_ahead``,
    that many times as many pages with text, or no further link. Records of a wave are landed; the number of waves
    grows with the logarithm of a site's links.
    """
    quotas = C.site_quotas(sites)
    links = landed(links.select("source_url", "article_url", "pos"), "links")
    counts = links.groupBy("source_url").agg(F.count(F.lit(1)).alias("_links"))
    waiting = landed(quotas.join(counts, "source_url"), "waiting")
    largest, before, upto, waves = C.largest_quota(sites), 0, FIRST_WAVE, []
    while True:
        ranked = first_n_per_group(
            links.join(waiting.select("source_url"), "source_url", "left_semi"), ["source_url"],
            [F.col("pos"), F.col("article_url")], largest * upto, ["article_url", "pos"])
        wave = ranked.join(waiting, "source_url").filter(
            (F.col("rank") > F.col("quota") * before) & (F.col("rank") <= F.col("quota") * upto))
        records = extract(linked_pages(wave.select(*links.columns), pages)).withColumns({
            "_text": F.coalesce(F.col("content") != "", F.lit(False)), "_usable": usable(F.col("content"), F.col("headline"))})
        waves.append(landed(records, "wave"))
        found = waves[0]
        for more in waves[1:]:
            found = found.unionByName(more)
        seen = found.groupBy("source_url").agg(F.count_if("_text").alias("_texts"), F.count_if("_usable").alias("_good"))
        filled = F.coalesce(F.col("_good"), F.lit(0)) >= F.col("quota")
        if read_ahead is not None:
            filled = filled | (F.coalesce(F.col("_texts"), F.lit(0)) >= F.col("quota") * read_ahead)
        waiting = landed(waiting.join(seen, "source_url", "left").filter(
            ~filled & (F.col("_links") > F.col("quota") * upto)).select("source_url", "quota", "_links"), "waiting")
        if waiting.isEmpty():
            return found.drop("_text", "_usable")
        before, upto = upto, upto * GROWTH


def main_articles(sites: DataFrame, pages: DataFrame, bound: int | None = None) -> DataFrame:
    """First extractor: pages without text do not count for the read-ahead, so it is cut on what was extracted."""
    links = L.static_links(site_pages(sites, pages))
    return C.read_ahead(in_waves(links, pages, sites, X.extract_main, C.READ_AHEAD), sites, bound)


def fallback_articles(sites: DataFrame, pages: DataFrame) -> DataFrame:
    return in_waves(L.fallback_links(site_pages(sites, pages)), pages, sites, X.extract_fallback)


def rendered_articles(sites: DataFrame, rendered: DataFrame) -> DataFrame:
    return in_waves(L.rendered_links(site_pages(sites, rendered)), rendered, sites, X.extract_rendered)


def still_short(sites: DataFrame, found: DataFrame) -> DataFrame:
    """Sites that need more articles, with the number they lack."""
    counts = found.groupBy("source_url").agg(F.count(F.lit(1)).alias("_found"))
    wanted = C.site_quotas(sites)
    missing = F.col("quota") - F.coalesce(F.col("_found"), F.lit(0))
    return wanted.join(counts, "source_url", "left").select(
        "source_url", missing.cast("int").alias("quota")).filter(F.col("quota") > 0)


def fill_in_stages(
    extractors: dict[str, Callable[[DataFrame], DataFrame]], sites: DataFrame, methods: Sequence[str] = C.METHODS,
) -> DataFrame:
    """Usable articles of every site up to its quota, with the ``method`` that found them.

    ``extractors`` maps a method to a function from the sites that still need articles to article records. The
    functions are called in the order of ``methods``, so each extracts only for sites that are still short.
    """
    shared_folder(sites.sparkSession)
    bound = C.largest_quota(sites)
    found = None
    for priority, method in enumerate(methods):
        if method not in extractors:
            continue
        short = sites if found is None else still_short(sites, found)
        events = C.only_usable(extractors[method](short)).withColumns(
            {"method": F.lit(method), "priority": F.lit(priority)})
        taken = C.fill_quota(events, short, bound).checkpoint()
        found = taken if found is None else found.unionByName(taken)
    return found


def crawl(sites: DataFrame, pages: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """Usable articles of every site up to its quota from stored pages.

    ``rendered`` are pages saved from a browser; without them the third extractor reads the same pages. Pages may
    say by ``source_url`` for which site they were stored, and by ``seq`` in which order: a link leads to one page,
    the last one stored under its URL (for its site).
    """
    bound = C.largest_quota(sites)
    pages = last_pages(pages)
    shown = pages if rendered is None else last_pages(rendered)
    return fill_in_stages({
        "main": lambda short: main_articles(short, pages, bound),
        "fallback": lambda short: fallback_articles(short, pages),
        "rendered": lambda short: rendered_articles(short, shown),
    }, sites)
