"""Token counts of whole texts by rank-synchronous merging.

Texts are cut by the tokenizer's pattern. Distinct pre-tokens of a block of texts are held together as
ragged arrays of byte symbols; in each round every pre-token merges its lowest-ranked pair, all at once,
and the symbols that survive are counted. A worker remembers the counts of the pre-tokens it has met, up
to a fixed number of them, which changes the time only.

Scale: one pass over the table, no shuffle. A task holds one Arrow batch of rows, cut into blocks of texts.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import bounded_batches, or_blank
from newsloom.llm.merging import MergeTable, merge_all
from newsloom.llm.pretokens import blocks, chunks, finder

REMEMBERED = 1 << 19
LIMIT = 512


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    stands for itself, the other bytes in order for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Counter:
    """Counts tokens as the tokenizer file says: byte-level pre-tokens, ranked merges, added strings."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.table = MergeTable(
            [vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], range(len(pairs)),
            [vocab[a + b] for a, b in pairs])
        self.byte_ids = np.array([vocab[c] for _, c in sorted(byte_symbols().items())], np.int64)
        self.find = finder(pattern)
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.known: dict[str, int] = {}

    def _chunks(self, text: str) -> tuple[list[str], int]:
        """Chunks of the text around added strings, and the number of those."""
        if self.added is None or not self.added.search(text):
            return chunks(text), 0
        parts = self.added.split(text)
        return [c for part in parts for c in chunks(part)], len(parts) - 1

    def _learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
        words = {c: self.find(c) for c in new}
        distinct = list(set().union(*words.values()))
        symbols = [self.byte_ids[np.frombuffer(w.encode("utf-8", "surrogatepass"), np.uint8)] for w in distinct]
        left = dict(zip(distinct, map(len, merge_all(symbols, self.table)), strict=True))
        self.known.update((c, sum(map(left.__getitem__, parts))) for c, parts in words.items())

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self._chunks(t) for t in texts]
        met = set().union(*(parts for parts, _ in cut))
        if new := [c for c in met if c not in self.known]:
            self._learn(new)
            if lost := [c for c in met if c not in self.known]:  # the memory was cleared in between
                self._learn(lost)
        known = self.known
        return [sum(map(known.__getitem__, parts)) + more for parts, more in cut]


_COUNTERS: dict[tuple[str, str], Counter] = {}


def _counter(path: str, pattern: str) -> Counter:
    """One per worker process, kept for its next tasks."""
    if (path, pattern) not in _COUNTERS:
        _COUNTERS[path, pattern] = Counter(path, pattern)
    return _COUNTERS[path, pattern]


def count_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``, whole texts, repeated rows too.

    ``path`` is a byte-level BPE file in JSON, readable on every executor. Strings that the file adds to the
    vocabulary count as one token wherever they stand in a text. Null text counts as empty with 0 tokens;
    null identifiers stay null. An empty table gives an empty result.
    """
    def run(batches):
        counter = _counter(path, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [n for block in blocks(texts) for n in counter.counts(block)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    rows = bounded_batches(docs).select(
        F.col(id_col).alias("doc_id"), or_blank(F.col(text_col)).alias("text"),
        F.octet_length(or_blank(F.col(text_col))).cast("long").alias("n_bytes"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)
