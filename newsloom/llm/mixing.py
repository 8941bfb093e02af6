"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document is expected ``target / source words`` times: the whole
part of that is allocated to every document of the source as certain copies, and the rest is the inclusion
probability of one more copy. Documents are ranked by random odds divided by inclusion odds, and the
smallest ranks are taken until the source's remaining words are reached.

Scale: texts are read once to count words; all else works on landed narrow rows. No source is sorted as a
whole: sums over cells of the random number, twice refined, find the cell in which a source's cut lies,
and only that cell's rows are ordered. The number of sources should fit one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import NO_ID, WORD, or_blank, written

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MOST_COPIES = 2
CELLS = 4096
SEED = "mix"
DRAW_BITS = 52


def draw(id_col: Column, seed: str = SEED) -> Column:
    """A whole number below 2**52 that depends on the identifier and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), id_col.cast("string"))), 1, 13), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, carry: Sequence[str]) -> DataFrame:
    return docs.select(
        *carry,
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.regexp_count(or_blank(F.col(text_col)), F.lit(WORD)).cast("long").alias("size"),
        draw(F.col(id_col), seed).alias("draw"), F.monotonically_increasing_id().alias("seq"))


def source_targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE,
                   most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target``: shares of ``share`` times all words by weight.

    Sources in order of code points, null last, take the weights in turn. No target exceeds ``most`` times
    its source; the excess goes to the others by weight. Sources sorted by cap over weight fill up in that
    order, so the level of the rest follows from running sums, and no repetition is needed.
    """
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = totals.withColumn("weight", F.element_at(
        F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("double")).withColumn(
        "cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.sum("source_size").over(everything) * float(share)
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = weighed.withColumn("level", (wanted - full) / open_weight).withColumn("place", F.row_number().over(order))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(everything)
    return levels.withColumn("at", level["level"]).select(
        "source", "source_size",
        F.coalesce(F.least("cap", F.col("at") * F.col("weight")), F.col("cap")).alias("target"))


def _cut(rows: DataFrame, cell: str, start: str) -> DataFrame:
    """The cell of each source in which its running sum reaches ``extra``, with the sum before that cell."""
    sums = rows.groupBy("source_no", "extra", start, cell).agg(F.sum("size").alias("_words"))
    running = F.sum("_words").over(Window.partitionBy("source_no").orderBy(cell)) + F.col(start)
    return sums.withColumn("_upto", running).filter(
        (F.col("_upto") >= F.col("extra")) & (F.col("_upto") - F.col("_words") < F.col("extra"))).select(
        F.col("source_no"), F.col(cell).alias("_cell"), (F.col("_upto") - F.col("_words")).alias("_start"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST_COPIES,
        seed: str = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, size, source, source_size, target, copies, taken`` of every row of ``docs``, and its columns ``carry``.

    ``copies`` is how often the mix holds the document, ``taken`` its words in the mix. The cut that comes
    nearest from below is closed by the one further document whose size fits the gap best. Null texts have
    size 0, null sources form one source, null identifiers share one draw; repeated rows are ranked one by
    one. Ties in rank go by identifier, then size. Empty tables give an empty result. Reruns agree.
    """
    landed = written(sized(docs, id_col, text_col, source_col, seed, carry), "mix-sizes")
    targets = written(source_targets(landed, weights, share, most).withColumns({
        "certain": F.floor(F.col("target") / F.nullif("source_size", F.lit(0))).cast("long"),
        "source_no": F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))}).withColumn(
        "certain", F.coalesce("certain", F.lit(0))).withColumn(
        "extra", F.col("target") - F.col("certain") * F.col("source_size")), "mix-targets")
    rows = landed.join(targets, landed["source"].eqNullSafe(targets["source"])).drop(targets["source"])

    # Random odds over inclusion odds: grows with the draw within a source, so cells of the draw nest in it.
    random = (F.col("draw") + 0.5) / float(2 ** DRAW_BITS)
    chance = F.col("extra") / F.nullif("source_size", F.lit(0))
    odds = (random / (1 - random)) / F.nullif(chance / F.nullif(1 - chance, F.lit(0.0)), F.lit(0.0))
    coarse = F.shiftright("draw", DRAW_BITS - 12)
    fine = F.shiftright("draw", DRAW_BITS - 24)
    ranked = rows.withColumns({"odds": odds, "coarse": coarse, "fine": fine, "_zero": F.lit(0).cast("long")})

    first = _cut(ranked, "coarse", "_zero").select("source_no", F.col("_cell").alias("c1"), F.col("_start").alias("s1"))
    second = _cut(ranked.join(first, "source_no").filter("coarse = c1"), "fine", "s1").select(
        "source_no", F.col("_cell").alias("c2"), F.col("_start").alias("s2"))
    rank = F.struct("odds", "draw", F.coalesce("doc_id", F.lit(NO_ID)).alias("ident"), "size", "seq")
    order = Window.partitionBy("source_no").orderBy(rank)
    inside = ranked.join(second, "source_no").filter("fine = c2").withColumn(
        "_upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("s2"))
    cuts = written(inside.groupBy("source_no").agg(
        F.first("c2").alias("c2"), F.first("s2").alias("s2"), F.first("extra").alias("extra"),
        F.max(F.when(F.col("_upto") <= F.col("extra"), F.col("_upto"))).alias("_reached"),
        F.max(F.when(F.col("_upto") <= F.col("extra"), rank)).alias("last")).select(
        "source_no", "c2", "last", (F.col("extra") - F.coalesce("_reached", "s2")).alias("gap")), "mix-cuts")
    chosen = ranked.join(cuts, "source_no", "left").withColumn("prefix", F.coalesce(
        (F.col("fine") < F.col("c2")) | ((F.col("fine") == F.col("c2")) & F.coalesce(rank <= F.col("last"), F.lit(False))),
        F.lit(False)))
    closing = chosen.filter(~F.col("prefix") & (F.abs(F.col("size") - F.col("gap")) < F.col("gap"))).groupBy(
        "source_no").agg(F.min(F.struct(
            F.abs(F.col("size") - F.col("gap")).alias("miss"), rank.alias("rank"))).alias("best")).select(
        "source_no", F.col("best.rank.seq").alias("closing"))
    done = chosen.join(closing, "source_no", "left").withColumn("copies", F.col("certain") + (
        F.col("prefix") | (F.coalesce("closing", F.lit(-1)) == F.col("seq"))).cast("long"))
    return done.select("doc_id", "size", "source", "source_size", "target", "copies",
                       (F.col("size") * F.col("copies")).alias("taken"), *carry)

