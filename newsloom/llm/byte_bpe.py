"""Byte-level BPE encoding and decoding with a file of ranks.

Distinct pre-tokens are counted over all documents. The most frequent ones, a fixed number at most, are
encoded once, by higher-order functions that fold ranked merges over their bytes with the ranks as a
literal map. Documents are then cut into pre-tokens; frequent ones take their stored ids, and the same
fold encodes the rest in place. Decoding looks up the bytes of every id and concatenates them.

Scale: no text is shuffled, only partial counts of pre-tokens. The table of frequent pre-tokens is
broadcast; FREQUENT and LONG bound its size whatever the input. It changes the time, never the ids.
"""

from __future__ import annotations

import base64
import collections
import itertools
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.binding import apply, bind
from newsloom.llm.common import bounded_batches, most_frequent, or_blank, short_plans, written
from newsloom.llm.merging import MergeTable, merge_all
from newsloom.llm.pretokens import blocks, chunks, finder
from newsloom.llm.ragged import Digests, Ragged, spread

# Buckets of the literal map: a map is searched entry by entry, so each bucket holds about one.
BUCKETS = 1 << 16
# Pre-tokens that are broadcast with their ids, and the longest text of one in bytes.
FREQUENT = 1 << 20
LONG = 256
# Distinct chunks that a task gathers before it hands on counts, and that a worker remembers.
GATHERED = 1 << 18
REMEMBERED = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal, an array of small maps. Bytes are written as Latin-1 characters. A literal is no part of
    SQL text: parsed expressions keep the text they come from."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        text = piece.decode("latin-1")
        buckets[xxhash.xxh64_intdigest(text.encode(), seed=42) % BUCKETS][text] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _rank(piece: str) -> str:
    return f"try_element_at(ranks[int(xxhash64({piece}) & {BUCKETS - 1})], {piece})"


def _best(starts: str) -> str:
    """The lowest rank of two neighbouring pieces and where the first of them is, in one number."""
    pair = f"substring(b, x, get({starts}, i + 2) - x)"
    return f"array_min(transform({starts}, (x, i) -> {_rank(pair)} * 1024L + i))"


def folded(word: str, ranks: str) -> str:
    """SQL for the ids of ``word``, its bytes as Latin-1 characters: a fold over starts of pieces, each step
    joining the leftmost pair of the lowest rank. A word that is itself ranked is one id."""
    state = f"named_struct('s', t, 'm', {_best('t')})"
    step = "if(a.m is null, a, " + bind("array_remove(a.s, a.s[int(a.m & 1023L) + 1])", "t", state) + ")"
    ids = f"transform(slice(a.s, 1, size(a.s) - 1), (x, i) -> {_rank('substring(b, x, a.s[i + 1] - x)')})"
    fold = (f"aggregate(sequence(1, greatest(length(b) - 1, 1)), {bind('sequence(1, length(b) + 1)', 't', state)}, "
            f"(a, j) -> {step}, a -> {ids})")
    return bind(ranks, "ranks", bind(word, "b", f"if({_rank('b')} is not null, array({_rank('b')}), {fold})"))


def latin(word: Column) -> Column:
    return F.decode(F.encode(word, "utf-8"), "iso-8859-1")


class LongWords:
    """The same merges for pre-tokens above LONG bytes, whose fold would be quadratic."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        split = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
                 if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = zip(*split, strict=True) if split else ((), (), ())
        self.table = MergeTable(left, right, rank, rank)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def encode(self, word: bytes) -> list[int]:
        if word in self.ranks:
            return [self.ranks[word]]
        return merge_all([self.byte_ids[np.frombuffer(word, np.uint8)]], self.table)[0].tolist()


_LONG: dict[str, LongWords] = {}


def _long_words(path: str) -> LongWords:
    if path not in _LONG:
        _LONG[path] = LongWords(read_ranks(path))
    return _LONG[path]


def word_counts(texts: DataFrame, pattern: str) -> DataFrame:
    """``word, n`` of all pre-tokens of at most LONG bytes. Tasks hand on counts whenever they hold GATHERED chunks."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        find = finder(pattern)
        met: collections.Counter = collections.Counter()

        def emptied():
            counts: collections.Counter = collections.Counter()
            for chunk, n in met.items():
                for word in find(chunk):
                    counts[word] += n
            met.clear()
            kept = [(w, n) for w, n in counts.items() if len(w) <= LONG and len(w.encode()) <= LONG]
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                met.update(chunks(text))
                if len(met) > GATHERED:
                    yield emptied()
        yield emptied()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(
        texts: DataFrame, pattern: str, ranks: Column, most: int = FREQUENT) -> tuple[Digests, np.ndarray, np.ndarray]:
    """The most frequent pre-tokens, by digest, with the number of their ids and all ids together. Their number
    and length are bounded by ``most`` and LONG."""
    top = most_frequent(written(word_counts(texts, pattern), "bpe-words"), most).select("word")
    dealt = top.repartition(max(1, 2 * texts.sparkSession.sparkContext.defaultParallelism))
    encoded = dealt.select("word", latin(F.col("word")).alias("w")).select(
        "word", apply(ranks, f"rank_table -> {folded('w', 'rank_table')}").alias("ids"))
    words = written(encoded, "bpe-ids").toArrow()
    parts = [c for c in words.column("ids").chunks if len(c)]
    lengths = [c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in parts]
    ids = [c.flatten().to_numpy(zero_copy_only=False).astype(np.int32) for c in parts]
    return (Digests(w.as_py() for w in words.column("word")),
            np.concatenate([np.empty(0, np.int64), *lengths]), np.concatenate([np.empty(0, np.int32), *ids]))


class Encoder:
    """Ids of texts as far as they are known. One per worker process, for as long as its broadcast lives."""

    def __init__(self, known: tuple[Digests, np.ndarray, np.ndarray], path: str, pattern: str) -> None:
        self.find, self.path = finder(pattern), path
        self.known, self.length, self.flat = known
        self.first = np.cumsum(self.length) - self.length
        self.long: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.chunk = Ragged(np.int32)
        self.open_words: list[str] = []

    def _unknown(self, word: str) -> int:
        """The number of a word that is not in the table: its place, if it is long; else it stays open."""
        if word in self.long:
            return self.long[word]
        if len(raw := word.encode()) <= LONG:
            self.open_words.append(word)
            return -len(self.open_words)
        ids = np.array(_long_words(self.path).encode(raw), np.int32)
        self.first, self.length = np.append(self.first, len(self.flat)), np.append(self.length, len(ids))
        self.flat = np.concatenate((self.flat, ids))
        self.long[word] = len(self.first) - 1
        return self.long[word]

    def _learn(self, new: list[str]) -> None:
        """A chunk's ids are those of its pre-tokens; -k stands for the k-th open word."""
        cut = [self.find(c) for c in new]
        words = list(itertools.chain.from_iterable(cut))
        rows = self.known.find(words)
        for i in np.flatnonzero(rows < 0):
            rows[i] = self._unknown(words[i])
        is_open = rows < 0
        each = np.ones(len(rows), np.int64)
        each[~is_open] = self.length[rows[~is_open]]
        flat = np.empty(int(each.sum()), np.int32)
        owner = np.repeat(is_open, each)
        flat[owner], flat[~owner] = rows[is_open], self.flat[spread(self.first[rows[~is_open]], each[~is_open])]
        ends = np.cumsum([len(c) for c in cut])
        sums = np.concatenate(([0], np.cumsum(each)))
        self.chunk.add(new, np.diff(sums[np.concatenate(([0], ends))]), flat)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts together, and where each text ends; a number -k stands for the k-th open word."""
        if len(self.chunk) > REMEMBERED:
            self._forget()
        flat, lengths = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for block in blocks(texts):
            cut = [chunks(t) for t in block]
            if new := self.chunk.missing(set().union(*cut)):
                self._learn(new)
            numbers = self.chunk.numbers(list(itertools.chain.from_iterable(cut)))
            sums = np.concatenate(([0], np.cumsum(self.chunk.length[numbers])))
            flat.append(self.chunk.gather(numbers))
            lengths.append(np.diff(sums[np.concatenate(([0], np.cumsum([len(c) for c in cut])))]))
        return np.concatenate(flat), np.cumsum(np.concatenate(lengths))

    def parts(self, texts: list[str]) -> pa.ListArray:
        """Per text its parts: known ids, then a word that is still open; the last part has none."""
        flat, ends = self.texts(texts)
        is_open = flat < 0
        at = np.flatnonzero(is_open)
        # An open word ends a part where it stands, a text ends one before the next text's first id.
        order = np.argsort(np.concatenate((at, ends - 0.5)), kind="stable")
        known = np.concatenate(([0], np.cumsum(~is_open)))
        stops = np.concatenate((known[at], known[ends]))[order]
        words = np.empty(len(order), object)
        words[:len(at)] = [self.open_words[-i - 1] for i in flat[at]]
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], stops)), pa.int32()), pa.array(flat[~is_open], pa.int32()))
        parts = pa.StructArray.from_arrays([lists, pa.array(words[order], pa.string())], ["ids", "word"])
        counts = np.searchsorted(at, ends) + np.arange(1, len(ends) + 1)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], counts)), pa.int32()), parts)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, known, path: str, pattern: str) -> Encoder:
    """The worker's encoder for this run; one of an earlier run is let go."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(known.value, path, pattern)
    return _ENCODERS[name]


def _segments(texts: DataFrame, path: str, pattern: str, known) -> DataFrame:
    """``doc_id, parts``: known ids and words still to be encoded, in the order of the text."""
    name = uuid.uuid4().hex

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, known, path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), encoder.parts(batch.column("text").to_pylist())], ["doc_id", "parts"])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {id_type}, parts array<struct<ids array<int>, word string>>")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, ids`` of every row: the ids of the whole text as ``array<int>``.

    ``frequent`` bounds the pre-tokens that are encoded once and broadcast, and with them the driver's memory.
    ``path`` is a file of ranks, readable on every executor. Null and empty texts have no ids. Rows with
    equal identifiers are encoded one by one; a null identifier stays null. Special strings are ordinary
    text. An empty table gives an empty result.
    """
    ranks = rank_literal(read_ranks(path))
    texts = short_plans(bounded_batches(docs)).select(F.col(id_col).alias("doc_id"), or_blank(F.col(text_col)).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(frequent_words(texts, pattern, ranks, frequent))
    rest = folded("decode(encode(p.word, 'utf-8'), 'iso-8859-1')", "rank_table")
    joined = f"rank_table -> flatten(transform(parts, p -> if(p.word is null, p.ids, concat(p.ids, {rest}))))"
    return _segments(texts, path, pattern, known).select("doc_id", apply(ranks, joined).alias("ids"))


def piece_literal(ranks: dict[bytes, int]) -> Column:
    """The bytes of each id in the order of the ids, as strings of these bytes, whether they are text or not."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    listed = json.dumps([base64.b64encode(p).decode() for p in pieces])
    return F.from_json(F.lit(listed), "array<binary>").cast("array<string>")


def decoded(ids: str, path: str) -> Column:
    """The bytes that ``ids`` stand for, concatenated piece by piece. Unknown ids give null."""
    pieces = piece_literal(read_ranks(path))
    return apply(pieces, f"pieces -> cast(array_join(transform({ids}, x -> pieces[x]), '') as binary)")
