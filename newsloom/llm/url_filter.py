"""URL filter: host-suffix and path-prefix expressions against a rule table.

A URL is expanded into the expressions that a rule could equal: its host suffixes with as many labels as
some rule's host has, times its path prefixes as long as some rule's path. Expressions meet rules in an
equi-join on the first four bytes of their digest; the full digest is then compared, and the longest
fitting rule gives the verdict.

Scale: work is done per distinct URL, so a URL that a third of all rows share is judged once. The number
of expressions per URL is the number of distinct label counts times distinct path lengths among the rules,
however long the URL. Spark broadcasts the rules only if their measured size allows it; otherwise adaptive
execution splits the partitions of frequent expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.binding import settled
from newsloom.llm.common import ascii_lower, or_blank

# The rules of the contract as (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
DEFAULT = "allow"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case; empty without ``://``."""
    return ascii_lower(F.regexp_extract(or_blank(url), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(or_blank(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keyed(frame: DataFrame, host_col: str, path_col: str) -> DataFrame:
    # A line break cannot be part of a host label here, so host and path cannot run into each other.
    return frame.withColumn("digest", _digest(F.concat(F.col(host_col), F.lit("\n"), F.col(path_col)))).withColumn(
        "short", F.substring("digest", 1, 4))


def _usable(rules: DataFrame) -> DataFrame:
    """Rules without nulls, one verdict for each host and path: block when they disagree."""
    return rules.select(
        ascii_lower(F.col("rule_host")).alias("rule_host"), "rule_path", "rule_verdict").dropna().groupBy(
        "rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))


def _distinct_numbers(rules: DataFrame, number: Column) -> list[int]:
    """Bounded by the longest rule, not by their number: label counts or path lengths that occur."""
    return sorted(r[0] for r in rules.select(number.cast("int")).distinct().collect())


def expressions(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path`` of each URL with every host suffix and path prefix that could equal a rule."""
    labels = _distinct_numbers(rules, F.size(F.split("rule_host", r"\.")))
    lengths = _distinct_numbers(rules, F.length("rule_path"))
    parts = F.size(F.split("host", r"\."))
    suffixes = F.array_compact(F.array(*[
        F.when(parts >= n, F.substring_index("host", ".", -n)) for n in labels]).cast("array<string>"))
    prefixes = F.array_compact(F.array(*[
        F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]).cast("array<string>"))
    return urls.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """Every distinct URL of ``pages`` with host, path, the rule that wins and the verdict.

    ``rules`` has ``rule_host, rule_path, rule_verdict``. A rule fits its host and all subdomains when the
    path starts with its path. The longest host plus path wins, then the longer host, then the smaller rule.
    URLs that no rule fits get ``default``. A null URL, or one without ``://``, has empty host and path. Rules
    with a null are ignored; no rules or no URLs give defaults or an empty result.
    """
    usable = _usable(rules)
    urls = pages.select(F.col(url_col).alias("url")).distinct().select(
        "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    listed = _keyed(usable, "rule_host", "rule_path").withColumnRenamed("digest", "rule_digest")
    candidates = _keyed(expressions(urls, usable), "suffix", "prefix").join(listed, "short")
    # Spark would make the confirmation a join key; so it stays above the join, which is on the short prefix alone.
    fitting = settled(candidates.withColumn("same", F.col("digest") == F.col("rule_digest")), "same").filter("same")
    ranking = F.struct(
        -(F.length("rule_host") + F.length("rule_path")), -F.length("rule_host"),
        F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")
    best = fitting.groupBy(F.col("url").alias("_judged")).agg(F.min(ranking).alias("best"))
    return urls.join(best, F.col("url").eqNullSafe(F.col("_judged")), "left").select(
        "url", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def filter_pages(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages``, repeated rows and null identifiers too: page_id, host, path, rule, verdict."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    judged = judge_urls(pages, rules, url_col, default)
    return rows.join(judged, F.col("_url").eqNullSafe(F.col("url")), "left").select(
        "page_id", "host", "path", "rule", "verdict")
