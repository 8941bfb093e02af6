"""URL expressions with the results of Python's ``urllib.parse``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.binding import let

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"

# Link texts that never lead to an article.
EXCLUDED_TOKENS = ("#", "login", "signup", "register", "mailto:", "javascript:")
# Schemes for which a reference may be relative.
_RELATIVE_SCHEMES = ("", "http", "https", "ftp", "file")


def clean_url(url: Column) -> Column:
    """Leading control characters, and tabs and line breaks anywhere, are not part of a URL."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def netloc(url: Column) -> Column:
    """Authority with port and user part; empty where the URL has none, never an error."""
    return F.regexp_extract(
        clean_url(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def third_segment(url: Column) -> Column:
    """``url.split('/')[2]``, NULL where there are fewer pieces."""
    return F.try_element_at(F.split(url, "/", -1), F.lit(3))


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of a rooted path; a trailing one leaves a trailing slash."""
    segments = F.split(path, "/", -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    trailing = F.when(F.rlike(path, F.lit(r"(^|/)\.\.?$")), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>"))
    return let(F.array_join(F.concat(kept, trailing), "/"), lambda joined: F.when(
        F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined)))


def _parts(url: Column) -> Column:
    """Scheme, authority, path, query and fragment; an empty query or fragment is dropped, as it is
    when a URL is put together again."""
    def lead(value: Column) -> Column:
        return let(value, lambda v: F.when(F.length(v) == 1, "").otherwise(v))

    return F.struct(
        F.lower(F.regexp_extract(url, _SCHEME, 1)).alias("scheme"),
        F.regexp_extract(url, _PARTS, 1).alias("authority"),
        F.regexp_extract(url, _PARTS, 2).alias("path"),
        lead(F.regexp_extract(url, _PARTS, 3)).alias("query"),
        lead(F.regexp_extract(url, _PARTS, 4)).alias("fragment"),
    )


def _target_path(base: Column, path: Column) -> Column:
    folder = F.regexp_extract(base["path"], "^(.*/)[^/]*$", 1)
    rooted = let(folder, lambda f: F.when((f == "") & (base["authority"] != ""), F.lit("/")).otherwise(f))
    relative = F.regexp_replace(F.concat(rooted, path), "(?<=.)/{2,}(?=.)", "/")
    target = F.when(F.startswith(path, F.lit("/")), path).otherwise(relative)
    return let(target, lambda t: F.when(F.rlike(t, F.lit(r"(^|/)\.\.?(/|$)")), _without_dots(t)).otherwise(t))


def _prefixed(prefix: str, value: Column, suffix: str = "") -> Column:
    return F.when(value == "", F.lit("")).otherwise(F.concat(F.lit(prefix), value, F.lit(suffix)))


def _combine(base_url: Column, ref_url: Column, base: Column, ref: Column) -> Column:
    scheme = _prefixed("", base["scheme"], ":")
    host = F.concat(scheme, _prefixed("//", base["authority"]))
    other_scheme = (ref["scheme"] != "") & (
        (ref["scheme"] != base["scheme"]) | ~ref["scheme"].isin(*_RELATIVE_SCHEMES))
    return (
        F.when(ref_url == "", base_url)
        .when((base_url == "") | other_scheme, ref_url)
        .when(ref["authority"] != "", F.concat(
            scheme, F.lit("//"), ref["authority"], ref["path"], ref["query"], ref["fragment"]))
        .when(ref["path"] == "", F.concat(
            host, base["path"], F.when(ref["query"] == "", base["query"]).otherwise(ref["query"]),
            ref["fragment"]))
        .otherwise(F.concat(host, _target_path(base, ref["path"]), ref["query"], ref["fragment"]))
    )


def resolve(base: Column, href: Column) -> Column:
    """``urljoin(base, href)`` for web references."""
    return let(clean_url(href), lambda ref_url: let(
        F.struct(_parts(base).alias("base"), _parts(ref_url).alias("ref")),
        lambda p: _combine(base, ref_url, p["base"], p["ref"])))


def resolve_naive(base: Column, href: Column) -> Column:
    """Glue a relative link to the page URL with exactly one slash; empty links have no target."""
    glued = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(href, F.lit("/")))
    return F.when(href == "", F.lit(None)).when(F.startswith(href, F.lit("http")), href).otherwise(glued)


def has_excluded_token(url: Column) -> Column:
    return F.rlike(url, F.lit("|".join(EXCLUDED_TOKENS)))


def same_site(page_url: Column, target: Column) -> Column:
    """The page's authority occurs within the target's authority."""
    return F.contains(netloc(target), netloc(page_url))


def same_site_loose(page_url: Column, href: Column) -> Column:
    """An absolute link that mentions the page's domain anywhere."""
    return F.startswith(href, F.lit("http")) & F.contains(href, third_segment(page_url))


def snapshot_key(url: Column) -> Column:
    """File-name-like key of a stored page."""
    bare = F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    return F.concat(F.lit("downloaded_"), F.replace(bare, F.lit("/"), F.lit("_")), F.lit(".html"))
