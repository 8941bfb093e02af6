"""Line dedup by winnowing: later repeated runs of lines go, their first occurrence stays.

A window is the shortest run of lines, from each line on, that holds MIN_WORDS words. The smallest line hash
of a window is its fingerprint, so two equal runs of at least MIN_WORDS words always share one. Windows
whose fingerprint occurs at one place only are unique and go no further. The others are joined by their
content with its first occurrence, and at both ends of a run of matches the lines are compared one by one
with those around the first occurrence until they differ. What matches is deleted.

Scale: after one pass over the texts everything is hashes of lines. A passage that a third of all
documents share is one row per task before the shuffle; joins on it are split by adaptive execution.
Texts move once, to be put together again without the deleted lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import NO_ID, WORD, or_blank, written

MIN_WORDS = 50


def _landed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return written(docs.select(
        F.monotonically_increasing_id().alias("seq"), F.col(id_col).cast("long").alias("doc_id"),
        or_blank(F.col(text_col)).alias("text")), "line-texts")


def line_rows(landed: DataFrame) -> DataFrame:
    """``seq, ident, line, p, h, w``: lines with words, numbered by ``p``; ``h`` hashes the line without the
    blanks around it, ``w`` is its number of words."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(
        i.alias("line"), F.unhex(F.md5(F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))).alias("h"),
        F.regexp_count(x, F.lit(WORD)).alias("w")))
    worded = F.filter(lines, lambda x: x["w"] > 0)
    rows = landed.select("seq", F.coalesce("doc_id", F.lit(NO_ID)).alias("ident"), F.posexplode(worded).alias("p", "l"))
    return rows.select("seq", "ident", "p", "l.line", "l.h", "l.w")


def windows(lines: DataFrame, words: int) -> DataFrame:
    """``seq, ident, p, n, content, fp, fp_at``: the window from each line on, a digest of its lines, and where its
    fingerprint is (the last place of the smallest hash). Ends of texts with fewer words have none."""
    by_line = Window.partitionBy("seq").orderBy("p")
    upto = F.sum("w").over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("w").over(Window.partitionBy("seq"))
    placed = lines.withColumns({"start": (upto - F.col("w")).cast("long"), "whole": whole})
    # The lines that start within the next words, counted from this line's first word, are its window.
    frame = Window.partitionBy("seq").orderBy("start").rangeBetween(0, words - 1)
    least = F.min(F.struct("h", (-F.col("p")).alias("back"))).over(frame)
    found = placed.withColumns({"hashes": F.collect_list("h").over(frame), "least": least}).filter(
        F.col("start") + words <= F.col("whole"))
    return found.select(
        "seq", "ident", "p", F.size("hashes").alias("n"),
        F.unhex(F.md5(F.array_join(F.transform("hashes", F.hex), ""))).alias("content"),
        F.xxhash64("least.h").alias("fp"), (-F.col("least.back")).alias("fp_at"))


def matches(found: DataFrame) -> DataFrame:
    """``seq, p, n, first_seq, first_p`` of every window whose content occurs earlier, by identifier and place."""
    places = found.select("fp", "seq", "fp_at").distinct().groupBy("fp").agg(F.count(F.lit(1)).alias("places"))
    # Aggregates are written before they are joined: Spark splits a hot key only where both sides of a join come
    # straight from a shuffle.
    shared = written(places.filter("places > 1").select("fp"), "line-fingerprints")
    repeated = written(found.join(shared, "fp").select("seq", "ident", "p", "n", "content"), "line-repeated")
    firsts = written(repeated.groupBy("content").agg(
        F.min(F.struct("ident", "seq", "p")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1"), "line-firsts")
    return repeated.join(firsts, "content").filter(
        (F.col("seq") != F.col("first.seq")) | (F.col("p") != F.col("first.p"))).select(
        "seq", "p", "n", F.col("first.seq").alias("first_seq"), F.col("first.p").alias("first_p"))


def _alike(mine: str, first: str) -> str:
    """How many leading hashes of two arrays are equal."""
    return (f"coalesce(nullif(array_position(zip_with({mine}, {first}, (x, y) -> coalesce(x = y, false)), false), 0) - 1, "
            f"size({mine}))")


def extended(met: DataFrame, lines: DataFrame, words: int) -> DataFrame:
    """Matches with ``low`` and ``high``, the first and last line that match, extended both ways at the ends of
    runs. What lies beyond a run's end holds fewer words than a window, so ``words`` lines are enough to see."""
    run = Window.partitionBy("seq", "first_seq", F.col("first_p") - F.col("p")).orderBy("p")
    edged = met.withColumns({
        "opens": F.coalesce(F.lag("p").over(run) != F.col("p") - 1, F.lit(True)),
        "closes": F.coalesce(F.lead("p").over(run) != F.col("p") + 1, F.lit(True))})
    inner = edged.filter("NOT opens AND NOT closes").select("seq", F.col("p").alias("low"), (F.col("p") + F.col("n") - 1).alias("high"))
    arrays = written(lines.groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda s: s["h"]).alias("hs")), "line-arrays")
    ends = edged.filter("opens OR closes").join(arrays, "seq").join(
        arrays.select(F.col("seq").alias("first_seq"), F.col("hs").alias("first_hs")), "first_seq")
    after = _alike(f"slice(hs, p + n + 1, {words})", f"slice(first_hs, first_p + n + 1, {words})")
    before = _alike(*[f"reverse(slice({hs}, greatest({at} - {words}, 0) + 1, least({at}, {words})))"
                      for hs, at in (("hs", "p"), ("first_hs", "first_p"))])
    outer = ends.select(
        "seq", F.expr(f"p - if(opens, {before}, 0)").alias("low"), F.expr(f"p + n - 1 + if(closes, {after}, 0)").alias("high"))
    return inner.unionByName(outer)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text, n_lines, removed`` of every row: the text without its later repeated runs, its number of
    lines before, and the numbers of the lines removed, from 0.

    Lines end at line feeds and are equal when equal without the ASCII blanks around them; lines without words
    are neither matched nor removed. A run counts when it holds at least ``words`` words. Occurrences are
    ordered by identifier (null first) and place; rows repeated with one identifier, in an order that is fixed
    once the rows are landed. Null text counts as empty. An empty table gives an empty result.
    """
    landed = _landed(docs, id_col, text_col)
    lines = written(line_rows(landed), "line-hashes")
    met = written(matches(written(windows(lines, words), "line-windows")), "line-matches")
    gone = extended(met, lines, words).select("seq", F.explode(F.sequence("low", "high")).alias("p")).distinct()
    removed = gone.join(lines.select("seq", "p", "line"), ["seq", "p"]).groupBy("seq").agg(
        F.sort_array(F.collect_list("line")).alias("removed"))
    whole = landed.join(removed, "seq", "left").select(
        "doc_id", F.split("text", "\n", -1).alias("lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    return whole.select(
        "doc_id", F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), removed), i -> lines[i]), '\n')").alias("text"),
        F.size("lines").alias("n_lines"), "removed")
