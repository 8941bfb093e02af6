"""Near-duplicates by SimHash, found by multi-index hashing.

A fingerprint has one bit per position that is set in over half of the hashes of a text's word shingles.
Fingerprints are indexed by each of their segments. To find neighbours, a small Hamming ball is enumerated
within every segment, the table of that segment is asked for each value in it, and full distances are
verified: of two segments, one differs in at most one bit when three bits differ in all.

Scale: a text is read once and becomes one number. Equal fingerprints are one row from then on, so a group
of copies counts once whatever its size. Fingerprints that crowd a segment's value would meet in all pairs
there; those are linked through the points of their Hamming balls instead, where some hundred rows for each
fingerprint suffice however many share the value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import bounded_batches, or_blank, written
from newsloom.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
DISTANCE = 3
HALF = 32
BLOCK = 1 << 16
# Fingerprints that share a segment's value are compared one by one up to this many; beyond it they are
# linked through their Hamming balls. Both ways give the same components.
CROWD = 64


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash as a signed number; zero for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    line = b" ".join(words)
    starts = [0]
    for word in words:
        starts.append(starts[-1] + len(word) + 1)
    total = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for low in range(0, total, BLOCK):
        high = min(low + BLOCK, total)
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b - 1], SEED) for a, b in zip(
            starts[low:high], starts[low + width:high + width], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = SHINGLE_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` of every row and its columns ``carry``; null text counts as empty."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), found, *map(batch.column, carry)], ["doc_id", "fp", *carry])

    rows = bounded_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), or_blank(F.col(text_col)).alias("text"), *carry)
    carried = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, f"doc_id long, fp long{carried}")


def _segments(fps: DataFrame) -> DataFrame:
    """The table of each segment: ``part, value`` with what is needed to verify."""
    halves = F.array(
        F.struct(F.lit(0).alias("part"), F.shiftrightunsigned("fp", HALF).alias("value")),
        F.struct(F.lit(1).alias("part"), F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1)).alias("value")))
    return fps.select("*", F.inline(halves))


def _ball(segments: DataFrame) -> DataFrame:
    """Each segment's value and the values with one more bit set. Of two values that differ in one bit, the
    one without it finds the other."""
    more = f"transform(filter(sequence(0, {HALF - 1}), i -> (value & shiftleft(1L, i)) = 0), i -> value | shiftleft(1L, i))"
    return segments.withColumn("value", F.explode(F.expr(f"concat(array(value), {more})")))


def _crowd_links(crowded: DataFrame, distance: int) -> DataFrame:
    """Links that join all of these fingerprints which are at most ``distance`` bits apart, two or three.

    Of two that differ in two bits at most, both lie within one bit of some point: a point's fingerprints
    are linked to the smallest of them, its hub. Of three differing bits one of the two lacks at least two:
    with these two set it is at a point within one bit of the other, and is linked to that point's hub.
    """
    near = crowded.withColumn("point", F.explode(F.expr(
        "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")))
    hubs = near.groupBy("point").agg(F.min("fp").alias("hub"))
    reached = near
    if distance > 2:
        lacking = crowded.withColumn("bits", F.expr(
            "transform(filter(sequence(0, 63), i -> (fp & shiftleft(1L, i)) = 0), i -> shiftleft(1L, i))"))
        reached = near.unionByName(lacking.select("fp", F.explode(F.expr(
            "flatten(transform(bits, (x, i) -> transform(slice(bits, i + 2, 64), y -> fp | x | y)))")).alias("point")))
    return reached.join(hubs, "point").filter("fp <> hub").select(
        F.greatest("fp", "hub").alias("a"), F.least("fp", "hub").alias("b")).distinct()


def _met(probing: DataFrame, table: DataFrame, distance: int) -> DataFrame:
    """Pairs within ``distance`` bits that the balls of ``probing`` find in ``table``, both tables of segments."""
    probes = _ball(probing).select("part", "value", F.col("fp").alias("a"))
    differ = F.col("a").bitwiseXOR(F.col("fp"))
    high = F.bit_count(F.shiftrightunsigned(differ, HALF))
    low = F.bit_count(differ.bitwiseAND(F.lit((1 << HALF) - 1)))
    # A pair that both segments find is taken from the first; one that finds itself from the smaller side.
    own, other = F.when(F.col("part") == 0, high).otherwise(low), F.when(F.col("part") == 0, low).otherwise(high)
    return probes.join(table, ["part", "value"]).filter(
        (F.bit_count(differ) <= distance) & ((F.col("part") == 0) | (other > 1))
        & ((own > 0) | (F.col("a") < F.col("fp")))).select("a", F.col("fp").alias("b"))


def near_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``a, b`` whose components are those of all pairs within ``distance`` bits (at most 3).

    ``fps`` has distinct ``fp``. Two fingerprints in crowded values never meet in the segments' tables; one
    of them and one outside a crowd do.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius one cover distances up to 3")
    segments = _segments(fps)
    if distance < 2:
        return _met(segments, segments, distance)
    dense = written(segments.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > CROWD).select("part", "value"), "crowded-values")
    if dense.isEmpty():
        return _met(segments, segments, distance)
    crowded = written(segments.join(dense, ["part", "value"], "left_semi"), "crowded")
    sparse = segments.join(dense, ["part", "value"], "left_anti")
    return _met(sparse, segments, distance).unionByName(_met(crowded, sparse, distance)).unionByName(
        _crowd_links(crowded.select("fp").distinct(), distance))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = SHINGLE_WORDS, distance: int = DISTANCE, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs``, and its columns ``carry``.

    Words are runs of anything but ASCII blanks after lower-casing A-Z; shingles of ``width`` words count
    as often as they occur, a shorter text is one shingle, and a text without words has fingerprint zero.
    Fingerprints within ``distance`` bits are linked, and ``component_id`` is the smallest identifier that
    is reachable, the row's own included; null only if none of the component has an identifier. Null text
    counts as empty, repeated rows are in one component, an empty table gives an empty result.
    """
    rows = written(fingerprints(docs, id_col, text_col, width, carry), "simhash")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = components(near_links(classes.select("fp"), distance))
    joined = written(classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(joined.join(smallest, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id", *carry)
