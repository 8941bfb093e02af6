"""From pages to candidate article links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import html as H
from newsloom.functions import urls as U
from newsloom.functions import walk as W
from newsloom.functions.binding import settled

# What marks a link as leading to an article.
STATIC_PATHS = ("/news/", "/article/", "/story/")
STATIC_ENDINGS = (".html", ".shtml", ".shtm")
TEASER = "teaser"
HEADING_LINK = "heading-link"
RENDERED_LINK = "article-links"
RENDERED_HOLDERS = ("resource-item-meta", "card-title")
YEAR_PATHS = r"/20\d\d"
CARD, CARD_INFO = "card", "card-info"
RESULTS_PER_PAGE = 10


def anchors(pages: DataFrame, *kept: str, holders: Column | None = None) -> DataFrame:
    """One row per link of a page: ``source_url, pos, href, link_class, has_heading, parent_class``.

    ``kept`` names further page columns to carry along. Parents are read where ``holders`` holds; elsewhere, and
    without it, ``parent_class`` is ''.
    """
    found = W.links(F.col("html"), holders)
    rows = pages.select(*kept, F.col("url").alias("source_url"), F.posexplode(found).alias("pos", "_l"))
    tag, holder = F.col("_l.tag"), F.col("_l.holder")
    found_links = rows.select(
        *kept, "source_url", "pos",
        F.when(H.has_attribute(tag, "href"), H.attribute(tag, "href")).alias("href"),
        H.attribute(tag, "class").alias("link_class"), F.col("_l.heading").alias("has_heading"),
        F.coalesce(H.attribute(holder, "class"), F.lit("")).alias("parent_class"))
    return settled(found_links, "href", "link_class", "parent_class").filter(F.col("href").isNotNull())


def anchors_with_holder(pages: DataFrame, holder_tokens: tuple[str, ...]) -> DataFrame:
    """Anchors with ``parent_class``. The walk over a page's tags is made only where the page mentions
    one of the tokens; elsewhere no parent can have them."""
    return anchors(pages, holders=F.rlike("html", F.lit("|".join(holder_tokens))))


def article_like_static(url: Column, link_class: Column, parent_class: Column) -> Column:
    in_path = [F.contains(url, F.lit(p)) for p in STATIC_PATHS]
    ending = [F.endswith(url, F.lit(e)) for e in STATIC_ENDINGS]
    marked = [
        F.contains(parent_class, F.lit(TEASER)),
        F.contains(link_class, F.lit(TEASER)),
        F.contains(link_class, F.lit(HEADING_LINK)),
    ]
    return _any([*in_path, *ending, *marked])


def article_like_rendered(
    href: Column, link_class: Column, has_heading: Column, parent_class: Column, year_paths: bool = False,
) -> Column:
    paths = "|".join([*STATIC_PATHS, *([YEAR_PATHS] if year_paths else [])])
    by_path = F.rlike(href, F.lit(paths)) & ~F.startswith(href, F.lit("#")) & ~F.startswith(
        href, F.lit("javascript:"))
    holders = [F.contains(parent_class, F.lit(h)) for h in RENDERED_HOLDERS]
    return _any([by_path, F.contains(link_class, F.lit(RENDERED_LINK)), has_heading, *holders])


def _any(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result


def static_links(pages: DataFrame) -> DataFrame:
    """Candidates of the first extractor: same site, no excluded token, article-like."""
    rows = settled(anchors_with_holder(pages, (TEASER,)).withColumn(
        "article_url", U.resolve(F.col("source_url"), F.col("href"))), "article_url")
    url = F.col("article_url")
    kept = rows.filter(
        U.same_site(F.col("source_url"), url)
        & ~U.has_excluded_token(url)
        & article_like_static(url, F.col("link_class"), F.col("parent_class")))
    return first_seen(kept)


def fallback_links(pages: DataFrame) -> DataFrame:
    """Candidates of the second extractor: absolute links that mention the site."""
    href = F.col("href")
    kept = anchors(pages).filter(
        U.same_site_loose(F.col("source_url"), href) & ~U.has_excluded_token(href))
    return first_seen(kept.withColumn("article_url", href))


def rendered_links(pages: DataFrame, year_paths: bool = False) -> DataFrame:
    """Candidates of the third extractor, taken from rendered pages."""
    href = F.col("href")
    rows = anchors_with_holder(pages, RENDERED_HOLDERS)
    kept = rows.filter((href != "") & article_like_rendered(
        href, F.col("link_class"), F.col("has_heading"), F.col("parent_class"), year_paths))
    target = F.when(F.startswith(href, F.lit("http")), href).otherwise(
        U.resolve(F.col("source_url"), href))
    return first_seen(kept.withColumn("article_url", target))


def first_seen(links: DataFrame) -> DataFrame:
    """Unique links per site with the position of their first sight."""
    return links.groupBy("source_url", "article_url").agg(F.min("pos").alias("pos"))


def card_links(pages: DataFrame) -> DataFrame:
    """Listing links, ``source_url, article_url, listing_date, pos``, with the date printed on their card.

    A link's card is the nearest element of that class around it, or the link itself; its date is in the first
    information element within that card, which may lie in a card within the card. Links without a card, and
    cards without a date, give ''. ``pos`` counts the listing links of a page.
    """
    clean = H.without_noise(F.col("html"))
    listed = pages.filter(F.contains("html", F.lit(RENDERED_LINK))).select(F.col("url").alias("source_url"), clean.alias("_html"))
    cut = settled(listed.select("source_url", F.regexp_extract_all("_html", F.lit(H.TAG), 0).alias("_tags"),
                                F.split("_html", H.TAG, -1).alias("_texts")), "_tags", "_texts")
    walked = settled(cut.withColumn("_c", W.cards(F.col("_tags"), CARD, CARD_INFO, RENDERED_LINK)), "_c")
    dates = F.transform(F.col("_c.spans"), lambda s: F.coalesce(F.regexp_extract(
        H.inner_text(W.between(F.col("_tags"), F.col("_texts"), s["start"], s["end"])),
        r"([0-9]{2}\.[0-9]{2}\.[0-9]{4})", 1), F.lit("")))
    dated = settled(walked.select("source_url", "_c", dates.alias("_dates")), "_dates")
    found = F.transform(F.col("_c.listed"), lambda k: F.struct(
        k["tag"].alias("tag"), F.get(F.col("_dates"), F.get(F.col("_c.firsts"), k["card"])["first"]).alias("date")))
    links = dated.select("source_url", F.posexplode(found).alias("pos", "_l")).select(
        "source_url", "pos", U.resolve_naive(F.col("source_url"), H.attribute(F.col("_l.tag"), "href")).alias("article_url"),
        F.coalesce("_l.date", F.lit("")).alias("listing_date"))
    return settled(links, "article_url").filter(F.col("article_url").isNotNull()).groupBy("source_url", "article_url").agg(
        F.min(F.struct("pos", "listing_date")).alias("_f")).select(
        "source_url", "article_url", F.col("_f.listing_date").alias("listing_date"), F.col("_f.pos").cast("long").alias("pos"))


# --- search results -------------------------------------------------------------------------

def page_plan(queries: DataFrame) -> DataFrame:
    """The result pages to ask for: ``page``, ``start`` and the largest ``num`` of each."""
    pages = F.ceil(F.col("wanted") / RESULTS_PER_PAGE).cast("int")
    return queries.filter(F.col("wanted") > 0).select(
        "query", "wanted", F.explode(F.sequence(F.lit(0), pages - 1)).alias("page")
    ).select(
        "query", "page", (F.col("page") * RESULTS_PER_PAGE + 1).alias("start"),
        F.least(F.lit(RESULTS_PER_PAGE), F.col("wanted") - F.col("page") * RESULTS_PER_PAGE).alias("num"))


def payload_items(search_pages: DataFrame) -> DataFrame:
    """Add ``items``: the links listed in each payload, NULL where an item has none."""
    parsed = F.from_json("body", "items array<struct<link:string>>")
    return search_pages.withColumn(
        "items", F.coalesce(F.transform(parsed["items"], lambda i: i["link"]),
                            F.array().cast("array<string>")))


def payload_links(search_pages: DataFrame) -> DataFrame:
    """Every non-empty link of every payload."""
    return payload_items(search_pages).select(
        "query", "page", F.posexplode("items").alias("pos", "link")).filter(F.col("link") != "")


def first_links(search_pages: DataFrame, queries: DataFrame, block: int = 4096) -> DataFrame:
    """The links a search returns: pages in order until an error page, a short page or enough links.

    Running totals are built in two levels, within blocks of pages and across blocks, so a query with
    very many pages is spread over tasks; only counts are sorted, never payloads.
    """
    sized = payload_items(search_pages).join(queries, "query").filter(
        F.col("page") < F.ceil(F.col("wanted") / RESULTS_PER_PAGE)
    ).withColumn("links", F.filter("items", lambda x: x != "")).select(
        "query", "wanted", "page", "status", F.size("items").alias("n_items"), "links",
        F.size("links").cast("long").alias("n_links"), F.floor(F.col("page") / block).alias("block"))
    counts = sized.drop("links")
    totals = counts.groupBy("query", "block").agg(F.sum("n_links").alias("total"))
    across = Window.partitionBy("query").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "query", "block", F.coalesce(F.sum("total").over(across), F.lit(0)).alias("offset"))
    within = Window.partitionBy("query", "block").orderBy("page").rowsBetween(
        Window.unboundedPreceding, -1)
    running = counts.join(offsets, ["query", "block"]).withColumn(
        "before", F.col("offset") + F.coalesce(F.sum("n_links").over(within), F.lit(0)))
    asked = F.least(F.lit(RESULTS_PER_PAGE), F.col("wanted") - F.col("before"))
    failed = F.col("status") != 200
    last = failed | (F.col("n_items") < asked) | (F.col("before") + F.col("n_links") >= F.col("wanted"))
    stops = running.withColumn("_last", last).groupBy("query").agg(
        F.min(F.when(F.col("_last"), F.col("page"))).alias("stop"))
    kept = running.join(stops, "query").filter(
        ~failed & (F.col("stop").isNull() | (F.col("page") <= F.col("stop")))
    ).select("query", "page", "before", "wanted")
    return (
        sized.select("query", "page", "links").join(kept, ["query", "page"])
        .select("query", "wanted", "before", F.posexplode("links").alias("pos", "link"))
        .withColumn("position", F.col("before") + F.col("pos") + 1)
        .filter(F.col("position") <= F.col("wanted"))
        .select("query", "position", "link")
    )
