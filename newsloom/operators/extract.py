"""From pages to article records. Every extractor is one projection over ``url, html``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import dates as D
from newsloom.functions import html as H
from newsloom.functions.binding import let, settled
from newsloom.functions.text import or_empty
from newsloom.operators.quality import usable

_HEADING = r"(?is)<h([12])(?:\s[^>]*)?>(.*?)</h\1\s*>"
# Where the rendered extractor looks, in order.
CONTENT_PLACES = (
    ("article", ""),
    ("div", H.class_contains("content")),
    ("div", H.class_contains("body")),
    ("div", H.class_contains("main")),
    ("section", H.class_contains("content")),
    ("main", ""),
    ("body", ""),
)
LONG_ENOUGH = 200


def _meta(page: Column, key: str, value: str) -> Column:
    """The first meta tag of that name, '' if there is none."""
    return H.first_tag(page, "meta", H.has_value(key, value))


def _contents(*metas: Column) -> Column:
    return F.transform(F.array(*metas), lambda tag: H.attribute(tag, "content"))


def _texts(*elements: Column) -> Column:
    """Rendered texts of some elements; one function over an array keeps the plan small."""
    return F.transform(F.array(*elements), H.inner_text)


def _first_filled(*lists: Column) -> Column:
    """The first value of the lists that is there and not empty."""
    filled = F.filter(F.concat(*lists), lambda v: v != "")
    return F.coalesce(F.get(filled, F.lit(0)), F.lit(""))


def _page(html: Column) -> Column:
    return H.without_noise(html)


def first_heading(page: Column) -> Column:
    """Inner HTML of the first h1 or h2 of the page, '' if there is none."""
    return F.regexp_extract(page, _HEADING, 2)


def headline_fallback(page: Column) -> Column:
    return H.node_text(first_heading(page), "")


def headline_rendered(page: Column) -> Column:
    return _first_filled(
        _texts(*[H.element(page, h) for h in ("h1", "h2", "h3")]),
        _contents(_meta(page, "property", "og:title"), _meta(page, "name", "twitter:title")))


def headline_listing(page: Column) -> Column:
    return H.inner_text(first_heading(page))


def content_fallback(page: Column) -> Column:
    """``article``, else ``main``, else the first ``div`` whose class mentions content."""
    place = F.coalesce(
        H.element(page, "article"), H.element(page, "main"),
        H.element(page, "div", H.class_contains("content")))
    return or_empty(H.node_text(place, " "))


def content_rendered(page: Column) -> Column:
    """The first place with more than 200 characters, otherwise the last place that exists. The other
    places are looked at only if the first one is too short."""
    first, *others = (H.element(page, name, condition) for name, condition in CONTENT_PLACES)

    def choose(every: Column) -> Column:
        return F.coalesce(
            F.get(F.filter(every, lambda t: F.length(t) > LONG_ENOUGH), F.lit(0)),
            F.try_element_at(F.array_compact(every), F.lit(-1)),
            F.lit(""))

    return let(H.inner_text(first), lambda text: F.when(F.length(text) > LONG_ENOUGH, text).otherwise(
        let(F.concat(F.array(text), _texts(*others)), choose)))


def content_listing(page: Column) -> Column:
    """The first of an article-content div, an entry-content div, ``article`` or ``main``."""
    marked = "|".join(H.class_token(t) for t in ("article-content", "entry-content"))
    opening = (
        rf"(?i:<div(?=[\s/>])(?:{marked}){H._ATTRIBUTES}>|<article(?=[\s/>]){H._ATTRIBUTES}>|<main(?=[\s/>]){H._ATTRIBUTES}>)")
    name = F.lower(F.regexp_extract(F.regexp_extract(page, opening, 0), "^<([A-Za-z]+)", 1))
    found = F.struct(name.alias("name"), F.try_element_at(F.split(page, opening, 2), F.lit(2)).alias("rest"))
    inner = let(found, lambda f: F.coalesce(*[
        F.when(f["name"] == kind, H.balanced(f["rest"], kind)) for kind in ("div", "article", "main")]))
    return or_empty(H.inner_text(inner))


def date_fallback(page: Column) -> Column:
    return or_empty(H.node_text(H.element(page, "time"), ""))


def date_rendered(page: Column) -> Column:
    return _first_filled(
        _contents(
            _meta(page, "property", "article:published_time"),
            _meta(page, "name", "datePublished"),
            _meta(page, "name", "pubdate")),
        _texts(H.element(page, "time"), H.element(page, "span", H.class_contains("date"))))


def date_listing(page: Column, card_date: Column) -> Column:
    """The card's date, else the date in the article or podcast header, brought to one format."""
    spans = (H.element(page, "span", H.class_token(t)) for t in ("articleHeader-date", "podcastHeader-date"))
    header = F.coalesce(F.get(F.array_compact(_texts(*spans)), F.lit(0)), F.lit(""))
    return F.when(or_empty(card_date) != "", card_date).otherwise(D.card_date(header))


def title_main(page: Column) -> Column:
    return _first_filled(F.transform(
        F.array(H.element(page, "h1"), H.element(page, "title")), lambda e: H.node_text(e, "")))


def content_main(page: Column) -> Column:
    """Main text without navigation, header, footer and side parts, one line per text node."""
    place = F.coalesce(H.element(page, "article"), H.element(page, "body"), page)
    trimmed = F.regexp_replace(
        place, r"(?is)<(nav|footer|aside|header)(?=[\s>])[^>]*>.*?(?:</\1\s*>|\z)", "<!>")
    return or_empty(H.node_text(trimmed, "\n"))


def _record(pages: DataFrame, date: Column, headline: Column, content: Column) -> DataFrame:
    """The five-field article record, next to whatever identified the page."""
    fields = ("html", "url", "_page")
    keys = [c for c in pages.columns if c not in (*fields, "source_url", "listing_date")]
    origin = F.col("source_url") if "source_url" in pages.columns else F.col("url")
    record = pages.select(
        *keys, date.alias("date"), headline.alias("headline"), content.alias("content"),
        F.col("url").alias("article_url"), origin.alias("source_url"))
    return settled(record, "date", "headline", "content")


def extract_main(pages: DataFrame) -> DataFrame:
    """First extractor: title, main text and date by page structure."""
    rows = pages.withColumn("_page", _page(F.col("html")))
    page = F.col("_page")
    return _record(rows, date_rendered(page), title_main(page), content_main(page))


def extract_fallback(pages: DataFrame, only_usable: bool = True) -> DataFrame:
    """Second extractor; it returns usable articles only."""
    rows = pages.withColumn("_page", _page(F.col("html")))
    page = F.col("_page")
    record = _record(rows, date_fallback(page), headline_fallback(page), content_fallback(page))
    return record.filter(usable(F.col("content"), F.col("headline"))) if only_usable else record


def extract_rendered(pages: DataFrame, keep: Column | None = None) -> DataFrame:
    """Third extractor over rendered pages; ``keep`` replaces the usable-article test."""
    rows = pages.withColumn("_page", _page(F.col("html")))
    page = F.col("_page")
    record = _record(rows, date_rendered(page), headline_rendered(page), content_rendered(page))
    return record.filter(usable(F.col("content"), F.col("headline")) if keep is None else keep)


def extract_listing(pages: DataFrame) -> DataFrame:
    """Article pages found through listing cards; ``listing_date`` is the date on the card."""
    rows = pages.withColumn("_page", _page(F.col("html")))
    page = F.col("_page")
    card = F.col("listing_date") if "listing_date" in pages.columns else F.lit("")
    return _record(rows, date_listing(page, card), headline_listing(page), content_listing(page))
