"""Near copies by the Jaccard similarity of word shingles, found by SimHash and MinHash and verified exactly.

Each text has a SimHash fingerprint of its shingles; fingerprints within three bits are found by multi-index
hashing, as in ``simhash``. Three bits reach the nearest copies alone, a similarity of 0.8 is some ten bits
apart; the others are found by MinHash. A signature has the smallest of a text's shingle hashes under each of SEGMENTS x ROWS permutations, and texts
that agree in a whole segment are candidates. Of pairs with Jaccard 0.8 one in 38,000 shares no segment.
Candidates are verified on all of their shingles, so no pair below the similarity is linked.

Scale: a text is read once and becomes SEGMENTS numbers and a fingerprint; the shingles of candidates alone are read again. A
segment value that many texts share would meet in all pairs there; its texts are first compared with
two hubs. Texts that this leaves apart meet in rare shingles of their differences from the hub, and only where sizes
and places of these leave room for the similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import bounded_batches, or_blank, written
from newsloom.llm.components import components
from newsloom.llm.exact_dedup import only_hits
from newsloom.llm.simhash import near_links

SHINGLE_WORDS = 5
SIMILARITY = 0.8
SEGMENTS = 20
ROWS = 4
SEED = 42
BLOCK = 1 << 13
# Texts that share a segment value are compared one by one up to this many. It changes the time only.
CROWD = 16
# Similar texts differ in at most this part of the sum of their numbers of shingles.
APART = (1 - SIMILARITY) / (1 + SIMILARITY)
# Makes up for rounding of numbers that are compared with such bounds.
ROUNDING = 1e-6
# Differences of one class have sizes that differ by less than this factor. It changes the time only.
STEP = 1.1

_DRAW = np.random.default_rng(SEED).integers(0, 1 << 63, (2, SEGMENTS * ROWS, 1), np.uint64)
_MIX, _FACTOR = _DRAW[0], _DRAW[1] * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, width: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Hashes of all runs of ``width`` words, in blocks; a shorter text is one run, one without words an empty run."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(words)
    width = max(1, min(width, len(words)))
    starts = [0]
    for word in words or [b""]:
        starts.append(starts[-1] + len(word) + 1)
    for low in range(0, len(starts) - width, BLOCK):
        high = min(low + BLOCK, len(starts) - width)
        yield np.array([xxhash.xxh64_intdigest(line[a:b - 1], SEED) for a, b in zip(
            starts[low:high], starts[low + width:high + width], strict=True)], np.uint64)


def signature(text: str) -> tuple[list[int], int]:
    """One number for each segment, where numbers of different segments differ, and the SimHash of all shingles."""
    least = np.full(SEGMENTS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text):
        np.minimum(least, ((hashes ^ _MIX) * _FACTOR).min(axis=1), out=least)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    found = [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(SEGMENTS, ROWS))]
    return found, int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def _signed(docs: DataFrame) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signature(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array([f for f, _ in found], pa.list_(pa.int64())),
                 pa.array([fp for _, fp in found], pa.int64())], ["doc_id", "digest", "segments", "fp"])

    rows = bounded_batches(docs).select("doc_id", or_blank(F.col("text")).alias("text"), "digest")
    return rows.mapInArrow(run, "doc_id long, digest binary, segments array<long>, fp long")


def _fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """Candidates by SimHash: texts of one fingerprint with the first of them, and the first ones of fingerprints
    that ``near_links`` links."""
    classes = written(rows.groupBy("fp").agg(F.min("key").alias("first")), "near-fingerprints")
    alike = rows.select("key", "fp").join(classes, "fp").filter("key <> first").select(
        F.col("first").alias("a"), F.col("key").alias("b"))

    def side(name: str) -> DataFrame:
        return classes.select(F.col("fp").alias(name), F.col("first").alias(f"{name}_key"))

    linked = near_links(classes.select("fp")).join(side("a"), "a").join(side("b"), "b")
    return alike.unionByName(linked.select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b")))


def _shingles(texts: DataFrame) -> DataFrame:
    """``key, hashes``: the distinct shingle hashes of each text."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.concatenate(list(shingle_hashes(t)))).view(np.int64)
                     for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.list_(pa.int64()))], ["key", "hashes"])

    return texts.mapInArrow(run, "key long, hashes array<long>")


def _links(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The ``pairs`` of the least similarity or more."""
    def side(key: str) -> DataFrame:
        return shingles.select(F.col("key").alias(key), F.col("hashes").alias(f"{key}_hashes"), F.size("hashes").alias(f"{key}_n"))

    both = F.size(F.array_intersect("a_hashes", "b_hashes"))
    total = F.col("a_n") + F.col("b_n")
    # n / (total - n) >= s; texts of very different lengths are not looked into.
    fits = F.least("a_n", "b_n") >= F.lit(SIMILARITY) * F.greatest("a_n", "b_n")
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(
        F.when(fits, both / (total - both) >= SIMILARITY)).select("a", "b")


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    found = left.withColumnRenamed("key", "a").join(right.withColumnRenamed("key", "b"), on)
    return found.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hubs(crowded: DataFrame) -> DataFrame:
    """Two texts of each crowded value: the one that crowds have most in common, and another in each segment."""
    reach = crowded.groupBy("key").agg(F.sum("n").alias("reach"))
    return crowded.join(reach, "key").groupBy("value").agg(
        F.max(F.struct("reach", "key"))["key"].alias("h0"), F.min_by("key", F.xxhash64("key", "value")).alias("h1"))


def _hub_pairs(crowded: DataFrame, hubs: DataFrame) -> DataFrame:
    """Each text of a crowd with the two hubs of each of its values."""
    return _met(crowded.select("value", "key"), hubs.select("value", F.explode(F.array("h0", "h1")).alias("key")), ["value"])


def _class(differing: Column) -> Column:
    return F.floor(F.log(differing) / math.log(STEP)).cast("int")


def _placed_differences(apart: DataFrame, shingles: DataFrame) -> DataFrame:
    """One row for each text of ``apart`` (``hub, key, root``) and each place of its difference from the hub that a
    similar text can ask for: ``hub, hash, place``, with ``n`` shingles of the text, ``d`` in the difference and ``e``
    of these in another text's difference from this hub too. Places count from the rarest shingle on; the first
    ``d - e`` are those of no other text."""
    hubs = shingles.select(F.col("key").alias("hub"), F.col("hashes").alias("hub_hashes"))
    differ = F.concat(F.array_except("hashes", "hub_hashes"), F.array_except("hub_hashes", "hashes"))
    listed = written(apart.join(shingles, "key").join(hubs, "hub").select(
        "hub", "key", "root", F.size("hashes").alias("n"), F.size("hub_hashes").alias("hub_n"), differ.alias("differ")), "near-differ")
    each = listed.select("hub", "key", F.explode("differ").alias("hash"))
    often = each.groupBy("hub", "hash").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    shared = each.join(often, ["hub", "hash"]).groupBy("hub", "key").agg(
        F.sort_array(F.collect_list(F.struct("texts", "hash"))).alias("shared"))
    known = listed.withColumn("d", F.size("differ")).drop("differ").join(shared, ["hub", "key"]).withColumn("e", F.size("shared"))
    # Places of two similar texts add up to what they may differ in, and the larger has n / SIMILARITY shingles at most.
    most = F.floor(F.lit(APART * (1 + 1 / SIMILARITY)) * F.col("n") + ROUNDING).cast("int")
    asked = known.withColumn("shared", F.slice("shared", F.lit(1), F.greatest(F.lit(0), most - F.col("d") + F.col("e") + 1)))
    return asked.select("hub", "key", "root", "n", "hub_n", "d", "e", F.posexplode("shared").alias("at", "found")).select(
        "hub", "key", "root", "n", "hub_n", "d", "e", (F.col("d") - F.col("e") + F.col("at")).alias("place"), "found.hash")


def _pairs_apart(apart: DataFrame, shingles: DataFrame) -> DataFrame:
    """Pairs of ``apart`` (``hub, key, root``) of one hub and two roots, without those that cannot be similar.

    Texts x and y of sizes n differ in as many shingles as their differences X and Y from the hub do, and a similarity
    of s allows them APART * (n(x) + n(y)). As both would have one root if both were similar to the hub, one is not, and
    then X and Y of a similar pair meet: in at least (d(x) + d(y) - APART * (n(x) + n(y))) / 2 shingles, and in one.
    So with the shingles of all differences in one order, the first that X and Y share is in neither at a place above
    (d(x) - d(y) + APART * (n(x) + n(y))) / 2, and the same for y. Rare shingles come first, so what most texts of the
    crowd share, with the hub or apart from it, makes no pairs. Classes of d make an equality of its range.
    """
    rows = written(_placed_differences(apart, shingles), "near-places")
    cell = ["hub", "hash", "of_d"]
    table = rows.select("hub", "hash", _class(F.col("d")).alias("of_d"), *[
        F.col(c).alias(f"{c}_b") for c in ("key", "root", "n", "d", "e", "place")])
    # y has the larger difference, and it or x is not similar to the hub.
    least = F.greatest("d", F.floor(F.lit(APART) * (F.lit(SIMILARITY) * F.col("n") + F.col("hub_n")) - ROUNDING), F.lit(1))
    most = F.floor(F.col("d") + F.lit(APART * (1 + 1 / SIMILARITY)) * F.col("n") - 2 * F.col("place") + ROUNDING)
    probes = rows.withColumn("least", least).withColumn("most", most).filter("least <= most").select(
        "hub", "hash", "key", "root", "n", "d", "e", "place", F.explode(F.sequence(_class(F.col("least")), _class(F.col("most")))).alias("of_d"))
    may = F.lit(APART) * (F.col("n") + F.col("n_b")) + ROUNDING
    pairs = probes.join(table, cell).filter(
        (F.col("root") != F.col("root_b")) & F.expr("d < d_b OR d = d_b AND key < key_b")
        & (2 * F.col("place") <= F.col("d") - F.col("d_b") + may) & (2 * F.col("place_b") <= F.col("d_b") - F.col("d") + may)
        & (F.col("d") + F.col("d_b") - 2 * F.least("e", "e_b") <= may))
    return pairs.select(F.least("key", "key_b").alias("a"), F.greatest("key", "key_b").alias("b")).distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, root`` of every row of ``docs`` (``doc_id, text, digest``); rows with one ``root`` are
    reachable from each other over pairs of SIMILARITY or more.

    Words are runs of anything but ASCII blanks after lower-casing A-Z; each shingle counts once for a text,
    and a shorter text is one shingle. Null text counts as empty.
    """
    rows = written(_signed(docs).withColumn("key", F.monotonically_increasing_id()), "near-signatures")
    placed = rows.select("key", F.explode("segments").alias("value"))
    shared = placed.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = written(placed.join(shared, "value"), "near-candidates")
    alike = written(_fingerprint_pairs(rows), "near-alike")
    keys = met.select("key").unionByName(alike.select(F.explode(F.array("a", "b")).alias("key"))).distinct()
    wanted = rows.join(keys, "key", "left_semi").select("key", "digest", "doc_id")
    texts = only_hits(docs.select("doc_id", or_blank(F.col("text")).alias("text"), "digest"), wanted).alias("t").join(
        wanted.groupBy("digest").agg(F.collect_list("key").alias("keys")).alias("w"), "digest")
    # Rows of one digest have one text.
    whole = texts.groupBy("digest").agg(F.first("keys").alias("keys"), F.first("text").alias("text"))
    shingles = written(_shingles(bounded_batches(whole).select(F.explode("keys").alias("key"), "text")), "near-shingles")

    few, crowded = met.filter(F.col("n") <= CROWD).drop("n"), met.filter(F.col("n") > CROWD)
    hubs = written(_hubs(crowded), "near-hubs")
    links = written(_links(
        _met(few, few, ["value"]).unionByName(_hub_pairs(crowded, hubs)).unionByName(alike).distinct(), shingles), "near-links")
    roots = components(links)
    in_crowd = crowded.select("value", "key").join(roots, F.col("key") == F.col("node"), "left").select(
        "value", "key", F.coalesce("root", "key").alias("root"))
    mixed = Window.partitionBy("value")
    apart = written(in_crowd.withColumn("low", F.min("root").over(mixed)).withColumn("high", F.max("root").over(mixed)).filter(
        "low < high").join(hubs.withColumnRenamed("h0", "hub"), "value").select("hub", "key", "root").distinct(), "near-apart")
    if not apart.isEmpty():
        roots = components(links.unionByName(_links(_pairs_apart(apart, shingles), shingles)))
    return rows.join(roots, F.col("key") == F.col("node"), "left").select(
        "doc_id", "digest", F.coalesce("root", "key").alias("root"))
