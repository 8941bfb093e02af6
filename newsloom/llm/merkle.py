"""A Merkle manifest of a dataset: a digest for every row, for every group and for the whole, with proofs.

The identifiers of each group make a compressed bitmap, one row for each 64-bit word that is not empty, and
directories of popcounts above it. The rank of an identifier, which is the place of its leaf, is what the directories
hold before its word and the number of bits before its own; leaves are never sorted. Nodes then go to
arrays by key: ``SPAN`` levels of a tree fall together in one row of at most ``8 ** SPAN`` slots. The same is done
for what is left, up to the group's root, and for the roots of all groups. Proofs come down the same rows.

Scale: one pass over the texts; what is shuffled are digests. No directory part has more than 2^16 rows and no array
more than 512 slots, however large or uneven the groups are; a group's size only adds levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import NO_ID, ascii_lower, written

# Children of a node, levels that are reduced in one row, and the slots of such a row.
FAN_BITS, SPAN = 3, 3
FAN, SLOT_BITS = 1 << FAN_BITS, FAN_BITS * SPAN
# Identifiers of a bitmap word, and how many bits of a word's number each directory resolves, lowest first.
WORD_BITS = 6
DIRECTORIES = (10, 16, 16, 16)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
EMPTY_PATH = "CAST(array() AS ARRAY<STRUCT<left: STRING, right: STRING>>)"


def encoded(value: Column) -> Column:
    """A value as the leaf's digest takes it: its length in UTF-8 and itself, or a dash for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def tree_name(group: Column) -> Column:
    """The key of a group's tree. Names sort as the groups do, null before all others."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("+"), group.cast("string")))


def lowered_for_a_third(doc_id: Column, text: Column) -> Column:
    """The text as a tampering would leave it: A-Z lower-cased where 3 divides the checksum of the identifier."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    return F.when(F.coalesce(hit, F.lit(False)), ascii_lower(text)).otherwise(text)


# --- ranks by bitmap ------------------------------------------------------------------------

def _word(ident: Column) -> Column:
    return F.shiftright(ident, WORD_BITS)


def _bit(ident: Column) -> Column:
    return ident.bitwiseAND(F.lit(2 ** WORD_BITS - 1)).cast("int")


def _before(rows: DataFrame, part: list[str], key: str, size: str, name: str) -> DataFrame:
    window = Window.partitionBy(*part).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(size).over(window), F.lit(0)))


def bitmaps(leaves: DataFrame) -> DataFrame:
    """``tree, word, bits, rows, before, total``: the words of each tree's bitmap with the number of rows in earlier
    words and in the whole tree. Partial bitmaps are merged before they are shuffled."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("ident")))
    words = leaves.groupBy("tree", _word(F.col("ident")).alias("word")).agg(
        F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("rows"))
    words = written(words, "merkle-words")
    counts, levels = words.select("tree", F.col("word").alias("w0"), F.col("rows").alias("size")), []
    for i, width in enumerate(DIRECTORIES):
        upper = counts.withColumn(f"w{i + 1}", F.shiftright(f"w{i}", width))
        levels.append(_before(upper, ["tree", f"w{i + 1}"], f"w{i}", "size", f"b{i}").drop("size"))
        counts = upper.groupBy("tree", f"w{i + 1}").agg(F.sum("size").alias("size"))
    top = len(DIRECTORIES)
    # Word numbers have 58 bits, so the sign alone is left above the last directory.
    above = _before(counts, ["tree"], f"w{top}", "size", "before").withColumn(
        "total", F.sum("size").over(Window.partitionBy("tree"))).drop("size")
    for i in reversed(range(1, top)):
        above = levels[i].join(above, ["tree", f"w{i + 1}"]).select(
            "tree", f"w{i}", (F.col("before") + F.col(f"b{i}")).alias("before"), "total")
    placed = levels[0].join(above, ["tree", "w1"]).select(
        "tree", F.col("w0").alias("word"), (F.col("before") + F.col("b0")).alias("before"), "total")
    return written(words.join(placed, ["tree", "word"]), "merkle-bitmaps")


def _repeats(leaves: DataFrame, maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For words with more rows than bits: ``tree, word, more``, the further rows of each bit, and for every row of
    a repeated identifier its place among them, by digest. Equal rows can take each other's place.

    Rows are numbered within the part that wrote them and digests within their first digits, so that one
    identifier on very many rows is spread over tasks.
    """
    full = maps.filter(F.col("rows") > F.bit_count("bits")).select("tree", "word")
    rows = leaves.withColumn("word", _word(F.col("ident"))).join(full, ["tree", "word"], "left_semi")
    cells = rows.groupBy("tree", "word", "ident", F.substring("node", 1, 4).alias("head"), "node", "claimed", "part").agg(
        F.count(F.lit(1)).alias("size"))
    heads = _before(cells.groupBy("tree", "ident", "head").agg(F.sum("size").alias("size")),
                    ["tree", "ident"], "head", "size", "earlier").drop("size")
    order = Window.partitionBy("tree", "ident", "head").orderBy("node", "claimed", "part").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = cells.withColumn("within", F.coalesce(F.sum("size").over(order), F.lit(0))).join(
        heads, ["tree", "ident", "head"])
    firsts = placed.select("tree", "ident", "node", "claimed", "part", (F.col("earlier") + F.col("within")).alias("first"), "size")
    more = cells.groupBy("tree", "word", "ident").agg((F.sum("size") - 1).alias("more")).filter("more > 0")
    by_word = more.groupBy("tree", "word").agg(
        F.collect_list(F.struct(_bit(F.col("ident")).alias("bit"), "more")).alias("more"))
    return by_word, firsts


def ranked(leaves: DataFrame) -> DataFrame:
    """``leaves`` (``tree, ident, doc_id, node, claimed, part``) as ``tree, idx, total`` with the rest: each leaf's
    place in its tree by rank in the bitmap. Only repeated identifiers take a second way."""
    maps = bitmaps(leaves)
    bit = _bit(F.col("ident"))
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))
    keep = ("tree", "ident", "doc_id", "node", "claimed", "part", "total", "idx")
    found = leaves.withColumn("word", _word(F.col("ident"))).join(maps, ["tree", "word"]).withColumn(
        "idx", F.col("before") + F.bit_count(F.col("bits").bitwiseAND(below)))
    if maps.filter(F.col("rows") > F.bit_count("bits")).isEmpty():
        return found.select("tree", "idx", "total", "doc_id", "node", "claimed")
    more, firsts = _repeats(leaves, maps)
    found = found.join(more, ["tree", "word"], "left")
    further = F.coalesce(F.aggregate(
        F.filter("more", lambda m: m["bit"] < bit), F.lit(0).cast("long"), lambda s, m: s + m["more"]), F.lit(0))
    found = found.withColumn("idx", F.col("idx") + further).select(*keep)
    # Rows of one cell are all equal: one row stands for them and is laid out over their places.
    key = ["tree", "ident", "node", "claimed", "part"]
    null_safe = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    cells = found.dropDuplicates(key).alias("l").join(firsts.alias("r"), null_safe, "left").select(
        "l.*", F.coalesce("r.first", F.lit(0)).alias("first"), F.coalesce("r.size", F.lit(1)).alias("size"))
    places = F.explode(F.sequence(F.col("idx") + F.col("first"), F.col("idx") + F.col("first") + F.col("size") - 1))
    return cells.select("tree", places.alias("idx"), "total", "doc_id", "node", "claimed")


# --- trees ----------------------------------------------------------------------------------

def _levels(total: Column, round_: int) -> Column:
    """Levels of a tree of ``total`` leaves that fall into a round."""
    depth = F.when(total <= 1, 0).otherwise(F.ceil(F.length(F.bin(total - 1)) / FAN_BITS)).cast("int")
    return F.least(F.lit(SPAN), F.greatest(F.lit(0), depth - round_ * SPAN))


_UP = (f"transform(sequence(0, int((size(x) - 1) div {FAN})), "
       f"i -> sha2(array_join(slice(x, i * {FAN} + 1, {FAN}), ''), 256))")
_TOWER = ("aggregate(sequence(1, greatest(levels, 1)), array(nodes), (t, k) -> if(k > levels, t, "
          f"concat(t, transform(array(t[k - 1]), x -> {_UP}))))")


def _reduced(nodes: DataFrame, round_: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """Nodes laid out in slots: one row for each run of slots with the ``tower`` of its levels, written once."""
    slot = F.col("idx").bitwiseAND(F.lit(2 ** SLOT_BITS - 1)).cast("int").alias("slot")
    rows = nodes.groupBy("tree", F.shiftright("idx", SLOT_BITS).alias("block")).agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct(slot, "node", *carried))).alias("slots"))
    towers = rows.withColumns({"levels": _levels(F.col("total"), round_), "nodes": F.col("slots.node")}).select(
        "tree", "block", "total", "levels", F.expr(_TOWER).alias("tower"),
        *[F.col(f"slots.{c}").alias(c) for c in carried])
    return written(towers, "merkle-nodes")


def _grown(nodes: DataFrame, carried: tuple[str, ...] = ()) -> list[DataFrame]:
    """All rounds of the trees of ``nodes`` (``tree, idx, total, node``), from the leaves up."""
    rounds = [_reduced(nodes, 0, carried)]
    largest = rounds[0].agg(F.max("total")).first()[0] or 0
    while largest > 1 << SLOT_BITS:
        largest = -(-largest >> SLOT_BITS)
        rounds.append(_reduced(_tops(rounds[-1]), len(rounds)))
    return rounds


def _tops(rows: DataFrame) -> DataFrame:
    return rows.select("tree", F.col("block").alias("idx"), "total", F.expr("tower[levels][0]").alias("node"))


# The siblings of slot j on level k of a tower, to its left and to its right.
_PLACE = f"shiftright(j, {FAN_BITS} * k)"
_RUN = f"({_PLACE} - {_PLACE} % {FAN})"
_STEP = (f"named_struct('left', array_join(slice(tower[k], {_RUN} + 1, {_PLACE} % {FAN}), ''), "
         f"'right', array_join(slice(tower[k], {_PLACE} + 2, {FAN - 1} - {_PLACE} % {FAN}), ''))")
_PATH = f"concat(if(levels = 0, {EMPTY_PATH}, transform(sequence(0, levels - 1), k -> {_STEP})), path)"


def _paths_below(rows: DataFrame, above: DataFrame) -> DataFrame:
    """``tree, idx, node, path, subroot, root`` of every node below ``rows``, given those of their own tops."""
    each = (f"transform(sequence(0, size(tower[0]) - 1), j -> named_struct('idx', (block << {SLOT_BITS}) + j, "
            f"'node', tower[0][j], 'path', {_PATH}))")
    joined = rows.join(above.drop("node").withColumnRenamed("idx", "block"), ["tree", "block"])
    return joined.select("tree", "subroot", "root", F.inline(F.expr(each)))


def _numbered_trees(subroots: DataFrame) -> DataFrame:
    """The tops of all trees as leaves of one, in the order of their names: numbered within ranges of names."""
    landed = written(subroots.select("tree", "node").repartitionByRange("tree").withColumn(
        "part", F.spark_partition_id()), "merkle-subroots")
    parts = landed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    # One row for each part of the range partitioning.
    offsets = _before(parts, [F.lit(0)], "part", "size", "offset").withColumn(
        "total", F.sum("size").over(Window.partitionBy(F.lit(0))))
    number = F.row_number().over(Window.partitionBy("part").orderBy("tree")) - 1
    return landed.withColumn("number", number).join(offsets.drop("size"), "part").select(
        F.col("tree").alias("name"), F.lit("").alias("tree"), (F.col("offset") + F.col("number")).alias("idx"), "total", "node")


def manifest(docs: DataFrame, claimed: Column | None = None, fields: tuple[str, ...] = FIELDS,
             group: str = "lang") -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, folded_root, verified`` of every row of ``docs``.

    ``fields`` are the columns that a leaf covers, identifier first and text last; ``claimed`` is the text whose
    presence is checked against the manifest, the text itself if it is not given. ``proof`` holds the siblings'
    digests from the leaf's level to the root's, and ``folded_root`` is what they and the claimed text give.

    Null values have their own encoding, unlike empty ones. A null group is a group of its own, before all others. Rows
    of a group with equal identifiers follow each other by digest, those without identifier come first. Rows
    that are equal in all fields have a leaf each. An empty table gives no rows; other columns are not read.
    """
    values = [F.col(f) for f in fields]
    told = leaf_digest([*values[:-1], claimed if claimed is not None else values[-1]])
    ident = F.coalesce(values[0].cast("long"), F.lit(NO_ID))
    leaves = written(docs.select(
        tree_name(F.col(group)).alias("tree"), ident.alias("ident"), values[0].alias("doc_id"),
        leaf_digest(values).alias("node"), told.alias("claimed"), F.spark_partition_id().alias("part")), "merkle-leaves")
    rounds = _grown(ranked(leaves), ("doc_id", "claimed"))
    trees = written(_numbered_trees(_tops(rounds[-1])), "merkle-trees")
    crowns = _grown(trees)
    top = _tops(crowns[-1]).select(
        "tree", "idx", F.expr(EMPTY_PATH).alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    for rows in reversed(crowns):
        top = _paths_below(rows, top)
    above = top.select("idx", "path", "root").join(trees.select("name", "idx", "node"), "idx").select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", F.col("node").alias("subroot"), "root")
    for rows in reversed(rounds[1:]):
        above = _paths_below(rows, above)
    folded = "aggregate(p, claimed[j], (h, s) -> sha2(concat(s.left, h, s.right), 256))"
    each = ("transform(sequence(0, size(tower[0]) - 1), j -> transform(array("
            f"{_PATH}), p -> named_struct('doc_id', doc_id[j], 'leaf', tower[0][j], "
            "'proof', array_join(transform(p, s -> concat(s.left, s.right)), ''), "
            f"'folded_root', {folded}))[0])")
    joined = rounds[0].join(above.withColumnRenamed("idx", "block"), ["tree", "block"])
    return joined.select("subroot", "root", F.inline(F.expr(each))).select(
        "doc_id", "leaf", "subroot", "root", "proof", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
