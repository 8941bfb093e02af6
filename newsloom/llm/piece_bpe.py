"""Encoding and decoding with a SentencePiece BPE model.

Blanks become the marker, and no piece of such a model has the marker after another character. So a
text falls into marked words whose segmentation does not depend on their neighbours. Each block of texts
gives a table of distinct marked words; every one that the worker does not know yet is segmented once, many at
a time in ragged numpy arrays, and the ids are joined back by the words' positions in the texts. Characters
outside the vocabulary become one piece for each of their bytes.

Scale: one pass over the table, no shuffle. A worker keeps the table of words it has met, up to a fixed
number of them, which changes the time only: a table for the whole corpus would have to be shuffled or broadcast.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_file

from newsloom.llm.common import bounded_batches, or_blank
from newsloom.llm.merging import NO_RANK, MergeTable
from newsloom.llm.pretokens import blocks
from newsloom.llm.ragged import Ragged, spread

MARK = "▁"
# Kinds of pieces in the model file, and what the unknown piece is decoded to.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2
UNKNOWN_TEXT = " ⁇ "
# Marked words that a worker remembers, and symbols from which a word is segmented by a heap.
REMEMBERED = 1 << 18
LONG = 96
_EMPTY = np.empty(0, np.int64)


class PieceModel:
    """Pieces, merges and the rules for blanks of a model file."""

    def __init__(self, path: str) -> None:
        spec = model_file.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        trained, rules = spec.trainer_spec, spec.normalizer_spec
        kinds = {p.type for p in spec.pieces}
        if (trained.model_type != BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix
                or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces
                or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}):
            raise ValueError("only BPE models with byte fallback and plain blanks are read")
        self.dummy_prefix = rules.add_dummy_prefix
        pieces = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces):
            raise ValueError("pieces cross the marker")
        self._read_merges(spec, pieces)
        self.byte_ids = np.zeros(256, np.int64)
        for i, piece in enumerate(spec.pieces):
            if piece.type == BYTE:
                self.byte_ids[int(piece.piece[1:-1], 16)] = i
        self.letter = np.full(0x110000, -1, np.int64)
        for piece, i in pieces.items():
            if len(piece) == 1:
                self.letter[ord(piece)] = i
        # Control characters that are in no piece merge with nothing, so they part words too.
        parting = re.escape("".join(c for c in map(chr, range(32)) if not any(c in piece for piece in pieces)))
        self.cut = re.compile(f"{MARK}*[^{MARK}{parting}]+|{MARK}+|[{parting}]+" if parting else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self._read_bytes(spec)

    def _read_merges(self, spec, pieces: dict[str, int]) -> None:
        """Any two neighbours that together make a piece merge; the better its score, the earlier. Equal scores
        have equal ranks and are taken from the left."""
        scores = sorted({spec.pieces[i].score for i in pieces.values()}, reverse=True)
        rank_of = {score: rank for rank, score in enumerate(scores)}
        merges = [(pieces[p[:k]], pieces[p[k:]], rank_of[spec.pieces[i].score], i) for p, i in pieces.items()
                  for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces]
        self.merges = MergeTable(*(zip(*merges, strict=True) if merges else ((), (), (), ())))
        self.pairs = {(left, right): (rank, merged) for left, right, rank, merged in merges}

    def _read_bytes(self, spec) -> None:
        """What each id is decoded to, as bytes."""
        decoded = []
        for piece in spec.pieces:
            if piece.type == BYTE:
                decoded.append(bytes([int(piece.piece[1:-1], 16)]))
            elif piece.type == NORMAL:
                decoded.append(piece.piece.replace(MARK, " ").encode())
            else:
                decoded.append(UNKNOWN_TEXT.encode() if piece.type == UNKNOWN else b"")
        self.piece_length = np.array([len(d) for d in decoded], np.int64)
        self.piece_first = np.cumsum(self.piece_length) - self.piece_length
        self.piece_bytes = np.frombuffer(b"".join(decoded), np.uint8)
        self.is_silent = np.array([p.type == CONTROL for p in spec.pieces])
        self.starts_marked = np.array([p.type == NORMAL and p.piece.startswith(MARK) for p in spec.pieces])

    def words(self, text: str) -> list[str]:
        """The marked words of a text, in order."""
        return self.cut((MARK if self.dummy_prefix and text else "") + text.replace(" ", MARK))

    def symbols(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the characters of all words together, bytes of those that are no piece, and the lengths of words."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        ids, each = self.letter[codes], np.ones(len(codes), np.int64)
        strange = np.flatnonzero(ids < 0)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        if len(strange):
            as_bytes = [chr(c).encode() for c in codes[strange]]
            each[strange] = [len(b) for b in as_bytes]
            flat = np.repeat(ids, each)
            flat[flat < 0] = self.byte_ids[np.frombuffer(b"".join(as_bytes), np.uint8)]
            ids = flat
        upto = np.concatenate(([0], np.cumsum(each)))
        return ids, np.diff(upto[np.concatenate(([0], ends))])

    def segment(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words together, and how many each has."""
        flat, lengths = self.symbols(words)
        first = np.cumsum(lengths) - lengths
        short = np.flatnonzero((lengths > 0) & (lengths <= LONG))
        found = [(short[names], ids, each) for names, (ids, each) in _merge_in_step(
            flat[spread(first[short], lengths[short])], lengths[short], self.merges)]
        for i in np.flatnonzero(lengths > LONG):
            ids = _merge_by_heap(flat[first[i]:first[i] + lengths[i]].tolist(), self.pairs)
            found.append((np.array([i]), np.array(ids, np.int64), np.array([len(ids)])))
        out_length = np.zeros(len(words), np.int64)
        for names, _, each in found:
            out_length[names] = each
        out, out_first = np.empty(int(out_length.sum()), np.int64), np.cumsum(out_length) - out_length
        for names, ids, each in found:
            out[spread(out_first[names], each)] = ids
        return out, out_length

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for. The marker of the prefix goes; bytes that are no UTF-8 become U+FFFD, each."""
        silent = np.flatnonzero(self.is_silent[ids])
        if not len(silent):
            return self._decode_part(ids, True)
        # A control piece also ends a run of bytes.
        parts = [part[part != ids[at]] for at, part in zip([silent[0], *silent], np.split(ids, silent), strict=True)]
        first = next((i for i, part in enumerate(parts) if len(part)), 0)
        return "".join(self._decode_part(part, i == first) for i, part in enumerate(parts))

    def _decode_part(self, ids: np.ndarray, first: bool) -> str:
        raw = self.piece_bytes[spread(self.piece_first[ids], self.piece_length[ids])].tobytes()
        if first and self.dummy_prefix and len(ids) and self.starts_marked[ids[0]]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _readable(raw)


def _readable(raw: bytes) -> str:
    """Bytes as text, with U+FFFD for each byte that belongs to no character."""
    parts = []
    while raw:
        try:
            parts.append(raw.decode())
            break
        except UnicodeDecodeError as error:
            parts.append(raw[:error.start].decode() + "�")
            raw = raw[error.start + 1:]
    return "".join(parts)


def _merge_in_step(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable) -> Iterator:
    """Many sequences at once: in each round every sequence joins the leftmost of its best pairs, one only, as a
    joined pair can make a better one. Yields ``names, (ids, lengths)`` of those without a pair left."""
    names = np.arange(len(lengths))
    if not len(names):
        return
    if not len(table.key):
        yield names, (symbols, lengths)
        return
    rank, place = table.look_up(symbols)
    place = np.append(place, 0)
    rank[np.cumsum(lengths) - 1] = NO_RANK
    while len(names):
        starts = np.cumsum(lengths) - lengths
        lowest = np.minimum.reduceat(rank, starts)
        going = lowest != NO_RANK
        if not going.all():
            kept = np.repeat(going, lengths)
            yield names[~going], (symbols[~kept], lengths[~going])
            symbols, rank, place = symbols[kept], rank[kept], place[kept]
            names, lengths, lowest = names[going], lengths[going], lowest[going]
            if not len(names):
                return
        best = np.flatnonzero(rank == np.repeat(lowest, lengths))
        starts = np.cumsum(lengths) - lengths
        at = best[np.searchsorted(best, starts)]
        symbols[at] = table.merged[place[at]]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, rank, place = symbols[stay], rank[stay], place[stay]
        lengths = lengths - 1
        ends = np.cumsum(lengths)
        at = at - np.arange(len(at))
        rank[at] = NO_RANK
        _renew(symbols, rank, place, at[at + 1 < ends], table)
        _renew(symbols, rank, place, at[at > ends - lengths] - 1, table)


def _renew(symbols, rank, place, at, table: MergeTable) -> None:
    """Ranks of the pairs that start at the given places."""
    key = symbols[at] * np.int64(1 << 20) + symbols[at + 1]
    found = np.minimum(np.searchsorted(table.key, key), len(table.key) - 1)
    rank[at] = np.where(table.key[found] == key, table.rank[found], NO_RANK)
    place[at] = found


def _merge_by_heap(symbols: list[int], pairs: dict) -> list[int]:
    """The same for one long sequence, in a time that grows little more than its length."""
    count = len(symbols)
    after, before = list(range(1, count + 1)), list(range(-1, count - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < count and (found := pairs.get((symbols[i], symbols[j]))):
            heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

    for i in range(count - 1):
        offer(i)
    while heap:
        _, i, left, right, merged = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= count or symbols[j] != right:
            continue
        symbols[i], symbols[j] = merged, -1
        after[i] = after[j]
        if after[i] < count:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s in symbols if s >= 0]


class Segmenter:
    """A model with the table of the marked words that the worker has met."""

    def __init__(self, path: str) -> None:
        self.model = PieceModel(path)
        self.table = Ragged(np.int32)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts together, and how many each has."""
        if len(self.table) > REMEMBERED:
            self.table = Ragged(np.int32)
        cut = [self.model.words(t) for t in texts]
        if new := self.table.missing(set().union(*cut)):
            ids, lengths = self.model.segment(new)
            self.table.add(new, lengths, ids)
        numbers = self.table.numbers(list(itertools.chain.from_iterable(cut)))
        upto = np.concatenate(([0], np.cumsum(self.table.length[numbers])))
        ends = np.cumsum([len(c) for c in cut], dtype=np.int64)
        return self.table.gather(numbers), np.diff(upto[np.concatenate(([0], ends))])


_SEGMENTERS: dict[str, Segmenter] = {}


def _segmenter(path: str) -> Segmenter:
    """One per worker process, kept for its next tasks."""
    if path not in _SEGMENTERS:
        _SEGMENTERS[path] = Segmenter(path)
    return _SEGMENTERS[path]


def _lists(parts: list[np.ndarray], lengths: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([_EMPTY, *parts]), pa.int32()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """``doc_id, ids`` of every row: the ids of the whole text as ``array<int>``, without begin or end ids; with
    ``decode`` also the text ``decoded`` that exactly these ids stand for.

    ``path`` is a model file, readable on every executor. Null and empty texts have no ids and are decoded to an empty
    text. Rows with equal identifiers are encoded one by one; a null identifier stays null. Names of special
    pieces within a text are ordinary text. An empty table gives an empty result; other columns are not read.
    """
    def run(batches) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(path)
        for batch in batches:
            parts, lengths, texts = [], [np.empty(0, np.int64)], []
            for block in blocks(batch.column("text").to_pylist()):
                ids, each = segmenter.encode(block)
                parts.append(ids)
                lengths.append(each)
                if decode:
                    texts += [segmenter.model.decode(part) for part in np.split(ids, np.cumsum(each)[:-1])]
            columns = [batch.column("doc_id"), _lists(parts, np.concatenate(lengths))]
            columns += [pa.array(texts, pa.string())] if decode else []
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), or_blank(F.col(text_col)).alias("text"))
    names = ["doc_id", "ids", "decoded"] if decode else ["doc_id", "ids"]
    more = ", decoded string" if decode else ""
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>{more}")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: the text of each row's ids. Null and empty lists are decoded to an empty text. Control pieces
    are silent; the unknown piece and broken byte sequences are decoded as the model's own library does."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        model = _segmenter(path).model
        for batch in batches:
            texts = [model.decode(np.asarray(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = bounded_batches(encoded).select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
