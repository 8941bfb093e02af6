"""Language identification by rank-order profiles.

The n-grams of one to three characters of all words, with their edges, are counted for each language over
the documents it may learn from. A language's profile is its most frequent n-grams in order. A document's
own most frequent n-grams are compared to every profile: the out-of-place distance adds how far each n-gram
is from its place there, and the full length of the profile where it is absent.

Scale: two passes over the table. Tasks count words, turn distinct words into n-grams, and hand on sums, so
what is shuffled does not grow with the texts. Profiles are bounded by the number of languages.
"""

from __future__ import annotations

import collections
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import bounded_batches, or_blank
from newsloom.llm.pretokens import blocks
from newsloom.llm.ragged import Ragged, spread

LONGEST = 3
PROFILE = 400
OWN = 300
UNKNOWN = "und"
# Distinct words that a task gathers, and whose n-grams it remembers, before it starts anew.
GATHERED = 1 << 18
REMEMBERED = 1 << 18
# Counts go by all numbers of n-grams while these are at most so many times those of the text.
DENSE = 16
BITS = 21
_LETTERS = re.compile(r"[^\W\d_]+")
# What the pattern above takes for the end of a word, though the letter before it goes on: marks, vowel signs.
_MARKED = regex.compile(r"\p{M}")
_LETTERS_AND_MARKS = regex.compile(r"[\p{L}\p{M}\p{Nl}\p{No}]+")
# The letters of the pattern above as they are and blanks for the rest, where a character is a byte. None is a mark.
_LATIN = bytes(i if _LETTERS.match(chr(i)) else 32 for i in range(256))


def words(text: str) -> list[str]:
    """Runs of letters and marks in lower case; other characters separate."""
    text = text.lower()
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return (_LETTERS_AND_MARKS if _MARKED.search(text) else _LETTERS).findall(text)


def _spelled(word: str) -> str:
    """A word without numerals that count as word characters; nothing if it has marks without any letter."""
    if word.isalpha():
        return word
    word = "".join(c for c in word if c.isalpha() or _MARKED.match(c))
    return word if any(map(str.isalpha, word)) else ""


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many n-grams each word has, and those of all words, one after the other. An n-gram of a word between
    blanks is packed into one number: a code point in 21 bits, after the one before it."""
    spelled = list(map(_spelled, words))
    letters = np.fromiter(map(len, spelled), np.int64, len(spelled))
    codes = np.frombuffer("".join([f" {w} " for w in spelled]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    counts = np.where(letters > 0, LONGEST * (letters + 2) - (LONGEST - 1) * LONGEST // 2 - 2, 0)
    flat = np.empty(int(counts.sum()), np.int64)
    first, start = np.cumsum(counts) - counts, np.cumsum(letters + 2) - letters - 2
    # Words without letters take two blanks in the line, but have no n-grams.
    keep = letters > 0
    first, start, letters = first[keep], start[keep], letters[keep]
    flat[spread(first, letters)] = codes[spread(start + 1, letters)]
    packed, first = codes, first + letters
    for n in range(1, LONGEST):
        packed = (packed[:-1] << BITS) | codes[n:]
        each = letters + 2 - n
        flat[spread(first, each)] = packed[spread(start, each)]
        first = first + each
    return counts, flat


def grams(word: str) -> np.ndarray:
    return grams_of([word])[1]


def counted(counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all words, and how often they occur."""
    each, flat = grams_of(list(counts))
    distinct, place = np.unique(flat, return_inverse=True)
    times = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), each)
    return distinct, np.bincount(place, times, len(distinct)).astype(np.int64)


def remainder(id_col: str, modulus: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % modulus


def profiles(learned: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``lang, gram, place`` from the rows of ``learned``: the PROFILE most frequent n-grams of each language;
    equal counts go in the order of the packed n-gram."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        met: dict[str, collections.Counter] = collections.defaultdict(collections.Counter)

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, counts in met.items():
                items = list(counts.items())
                each = [counted(dict(items[low:low + (1 << 15)])) for low in range(0, len(items), 1 << 15)]
                grams, place = np.unique(np.concatenate([np.empty(0, np.int64), *[g for g, _ in each]]), return_inverse=True)
                times = np.bincount(place, np.concatenate([np.empty(0), *[n for _, n in each]]), len(grams))
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(grams), pa.string()), pa.array(grams),
                    pa.array(times.astype(np.int64))], ["lang", "gram", "n"])
            met.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                met[lang].update(words(text))
            if sum(map(len, met.values())) > GATHERED:
                yield from emptied()
        yield from emptied()

    rows = learned.select(or_blank(F.col(text_col)).alias("text"), F.col(lang_col).alias("lang")).filter("lang IS NOT NULL")
    sums = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return sums.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PROFILE).select(
        "lang", "gram", "place")


class Judge:
    """Compares texts with the profiles of all languages. n-grams that it met are numbered, so that those of a text
    are counted by number."""

    def __init__(self, rows: list[tuple[str, int, int]], remembered: int = REMEMBERED) -> None:
        self.remembered = remembered
        self.langs = sorted({lang for lang, _, _ in rows})
        self.grams = np.array(sorted({gram for _, gram, _ in rows}), np.int64)
        self.places = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for lang, gram, place in rows:
            self.places[np.searchsorted(self.grams, gram), self.langs.index(lang)] = place - 1
        self._forget()

    def _forget(self) -> None:
        self.known = Ragged(np.int32)
        # The n-gram of each number, its row in the places, and the numbers in the order of the n-grams.
        self.packed, self.at, self.order = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        each, flat = grams_of(new)
        distinct, place = np.unique(flat, return_inverse=True)
        ordered = self.packed[self.order]
        found = np.searchsorted(ordered, distinct)
        met = np.zeros(len(distinct), bool)
        inside = found < len(ordered)
        met[inside] = ordered[found[inside]] == distinct[inside]
        number = np.empty(len(distinct), np.int64)
        number[met] = self.order[found[met]]
        number[~met] = len(self.packed) + np.arange(np.count_nonzero(~met))
        at = np.searchsorted(self.grams, distinct[~met])
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != distinct[~met]] = len(self.grams)
        self.packed, self.at = np.concatenate((self.packed, distinct[~met])), np.concatenate((self.at, at))
        self.order = np.argsort(self.packed, kind="stable")
        self.known.add(new, each, number[place])

    def judge(self, texts: list[str]) -> list[tuple[str, float]]:
        """Of each text the nearest language, ties to the smaller name, and one less its distance as a part of the
        largest possible; UNKNOWN and zero without letters, or when nothing was learned."""
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        found = []
        for block in blocks(texts):
            if len(self.known) > self.remembered:
                self._forget()
            counts = [collections.Counter(words(t)) for t in block]
            if new := self.known.missing(set().union(*counts)):
                self._learn(new)
            found += map(self._nearest, counts)
        return found

    def _nearest(self, counts: dict[str, int]) -> tuple[str, float]:
        words = self.known.numbers(counts.keys())
        ids = self.known.gather(words)
        if not len(ids):
            return UNKNOWN, 0.0
        times = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), self.known.length[words])
        if len(self.packed) <= DENSE * len(ids):
            sums = np.bincount(ids, times, len(self.packed))
            numbers = np.flatnonzero(sums)
            sums = sums[numbers]
        else:
            numbers, place = np.unique(ids, return_inverse=True)
            sums = np.bincount(place, times)
        if len(sums) > OWN:
            # All that are as frequent as the last one taken; the order decides among these.
            often = sums >= np.partition(sums, len(sums) - OWN)[len(sums) - OWN]
            numbers, sums = numbers[often], sums[often]
        own = numbers[np.lexsort((self.packed[numbers], -sums))[:OWN]]
        places = self.places[self.at[own]]
        apart = np.where(places < 0, PROFILE, np.abs(places - np.arange(len(own))[:, None]))
        distance = apart.sum(axis=0)
        best = int(np.argmin(distance))
        return self.langs[best], 1.0 - float(distance[best]) / (PROFILE * len(own))


def identify(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             carry: list[str] | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """The columns ``carry`` (by default the identifier) of every row of ``docs``, with ``lang_pred, score`` from
    its whole text alone.

    Learns from text and language of the rows that the condition ``learn`` selects and that have a language.
    ``lang_pred`` is a learned language, or ``und`` with score 0 for a text that is null or has no letters,
    or if nothing could be learned. ``score`` is between 0 and 1. Repeated rows get equal answers; ties go
    to the smaller name. An empty table gives an empty result. ``remembered`` words at most keep their n-grams
    in a task, which takes memory for time.
    """
    spark = docs.sparkSession
    bounded_batches(docs)
    learned = profiles(docs.filter(learn), text_col, lang_col).collect()
    shared = spark.sparkContext.broadcast([tuple(r) for r in learned])
    kept = docs.select(*(carry or [id_col]))
    names = kept.columns
    rows = kept if text_col in names else docs.select(*names, text_col)

    def run(batches) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value, remembered)
        for batch in batches:
            found = judge.judge([t or "" for t in batch.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([
                *map(batch.column, names), pa.array([lang for lang, _ in found], pa.string()),
                pa.array([score for _, score in found], pa.float64())], [*names, "lang_pred", "score"])

    schema = T.StructType([*kept.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)
