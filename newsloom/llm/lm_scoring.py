"""Language-model scores of whole texts: a causal self-attention model on subword ids, beside a unigram base.

Words (lower-cased A-Z, split at ASCII blanks) are cut into ids of a public vocabulary. Ids fall into
classes: the frequent ones have one of their own, the others are grouped by what stands beside them in words. The
model (``attention``) predicts classes; an id's part of its class comes from counts. Texts are cut into
overlapping windows, and each id is scored in the one window where it lies behind the overlap.

Scale: counts of words, ids, their neighbours and neighbouring classes are over all documents that may be
learned from, summed within tasks before they move. The attention weights are trained on every window of these
documents: each bucket of windows trains its own copy in a task, and the copies are averaged. Only the weights that
all copies start from are fitted on a bounded sample.
Documents are scored where they are read; words outside the broadcast table of frequent ones get their
counts by a join of narrow rows.
"""

from __future__ import annotations

import collections
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import attention
from newsloom.llm.byte_bpe import read_ranks
from newsloom.llm.common import arrow_bytes, bounded_batches, most_frequent, or_blank, written
from newsloom.llm.pretokens import blocks
from newsloom.llm.ragged import Ragged

CLASSES = 512
GROUPS = 32
# Frequent ids that count as a kind of neighbour of their own.
NEIGHBOURS = 64
# The sample that the starting weights are fitted on: so many distinct texts, so many windows of each at most.
SAMPLE_DOCS = 4096
SAMPLE_WINDOWS = 8
# Windows that the starting weights see in all, each at least twice and at most twenty times.
VISITS = 60_000
# Ids that one copy of the weights is trained on, about, and the windows of a piece of a text that is dealt out whole.
BUCKET_IDS = 1 << 20
PIECE_WINDOWS = 256
# Copies start from trained weights, so they learn at a lower rate.
COPY_RATE = 0.003
# Words whose counts are broadcast; distinct words that a task gathers or a worker remembers.
FREQUENT = 1 << 19
GATHERED = 1 << 18
SCORED = 64


class Subwords:
    """Ids of words, each with the space before it, by the ranks of a public vocabulary."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks = read_ranks(path)
        self.end = max(ranks.values()) + 1
        self._encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, word: bytes) -> list[int]:
        return self._encode(" " + word.decode("utf-8", "replace"))


_SUBWORDS: dict[tuple[str, str], Subwords] = {}


def _subwords(path: str, pattern: str) -> Subwords:
    if (path, pattern) not in _SUBWORDS:
        _SUBWORDS[path, pattern] = Subwords(path, pattern)
    return _SUBWORDS[path, pattern]


def words(text: str) -> list[bytes]:
    """Bytes lower-case A-Z only, and split at just the ASCII blanks."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over all of ``texts``."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in met], pa.string()), pa.array(list(met.values()), pa.int64())], ["word", "n"])

        met: collections.Counter = collections.Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                met.update(words(text))
                if len(met) > GATHERED:
                    yield rows()
                    met.clear()
        yield rows()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spelled(counts: DataFrame, path: str, pattern: str) -> DataFrame:
    """``counts`` with the ids of each word."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        cut = _subwords(path, pattern)
        for batch in batches:
            ids = [cut.ids(word.encode()) for word in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return counts.mapInArrow(run, "word string, n long, ids array<int>")


def sample_windows(texts: DataFrame, path: str, pattern: str) -> list[list[int]]:
    """Evenly spread windows of ids, up to SAMPLE_WINDOWS of each of the SAMPLE_DOCS distinct texts of the
    smallest hash: the same ones in every run, whatever the identifiers are and however often a text occurs."""
    length = attention.WINDOW + 1

    def run(batches) -> Iterator[pa.RecordBatch]:
        cut = _subwords(path, pattern)
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                ids = [cut.end] + [i for word in words(text) for i in cut.ids(word)] + [cut.end]
                starts = np.linspace(0, max(0, len(ids) - length), SAMPLE_WINDOWS).astype(int)
                found += [ids[s:s + length] for s in dict.fromkeys(starts.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["ids"])

    hashed = texts.select("text", F.xxhash64("text").alias("hash"))
    chosen = hashed.select("hash").distinct().orderBy("hash").limit(SAMPLE_DOCS)
    sample = hashed.join(F.broadcast(chosen), "hash", "left_semi").groupBy("hash").agg(F.min("text").alias("text"))
    return sorted(r[0] for r in sample.select("text").mapInArrow(run, "ids array<int>").collect())


def classes_of(known: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of every id below ``size``, the end first, and how often each occurs, from all words of the
    corpus: by frequency, and the rarer ids by what stands beside them within words. What is gathered are
    counts of ids, and of ids beside 2 * (NEIGHBOURS + 2) kinds, so the vocabulary bounds it."""
    often = np.zeros(size, np.int64)
    counts = known.select("n", F.explode("ids").alias("id")).groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    often[counts.column("id").to_numpy()] = counts.column("n").to_numpy()
    order = np.argsort(-often[:size - 1], kind="stable")
    single = order[:CLASSES - GROUPS - 1]
    classes = np.full(size, CLASSES - 1, np.int64)
    classes[size - 1], classes[single] = 0, np.arange(1, len(single) + 1)
    rare = order[len(single):]
    rare = rare[often[rare] > 0]
    if not len(rare):
        return classes, often
    kinds = known.sparkSession.createDataFrame(
        [(int(i), k) for k, i in enumerate(single[:NEIGHBOURS])], "other int, kind int")
    beside = F.transform("ids", lambda x, i: F.array(
        F.struct(x.alias("id"), F.get("ids", i - 1).alias("other"), F.lit(0).alias("side")),
        F.struct(x.alias("id"), F.get("ids", i + 1).alias("other"), F.lit(1).alias("side"))))
    # One kind for each frequent neighbour, one for all others, one for the edge of the word.
    kind = F.coalesce("kind", F.when(F.col("other").isNull(), NEIGHBOURS + 1).otherwise(NEIGHBOURS))
    met = known.select("n", F.inline(F.flatten(beside))).join(F.broadcast(kinds), "other", "left").groupBy(
        "id", (F.col("side") * (NEIGHBOURS + 2) + kind).alias("place")).agg(F.sum("n").alias("n")).toArrow()
    row = np.full(size, -1)
    row[rare] = np.arange(len(rare))
    at = row[met.column("id").to_numpy()]
    features = np.full((len(rare), 2 * (NEIGHBOURS + 2)), 0.02, np.float32)
    features[at[at >= 0], met.column("place").to_numpy()[at >= 0]] += met.column("n").to_numpy()[at >= 0]
    features = np.sqrt(features / features.sum(axis=1, keepdims=True))
    centres, weight = features[:GROUPS].copy(), often[rare]
    for _ in range(10):
        group = (features @ centres.T).argmax(axis=1)
        for g in np.unique(group):
            centre = weight[group == g] @ features[group == g]
            centres[g] = centre / np.linalg.norm(centre)
    classes[rare] = CLASSES - GROUPS + group
    return classes, often


def class_lines(texts: DataFrame, path: str, pattern: str, classes: np.ndarray) -> DataFrame:
    """``line``: the classes of every text, an end before and after, as 16-bit numbers. Long texts are cut into
    pieces that share one class, so that each class but a text's first follows another in just one line."""
    step = PIECE_WINDOWS * attention.WINDOW

    def run(batches) -> Iterator[pa.RecordBatch]:
        cut = _subwords(path, pattern)
        known = Ragged(np.int16)
        for batch in batches:
            for block in blocks(batch.column("text").to_pylist()):
                parts = [words(text) for text in block]
                if len(known) > GATHERED:
                    known = Ragged(np.int16)
                if new := known.missing(set().union(*parts)):
                    found = [cut.ids(word) for word in new]
                    flat = np.array([i for f in found for i in f], np.int64)
                    known.add(new, np.array([len(f) for f in found], np.int64), classes[flat])
                numbers = known.numbers(list(itertools.chain.from_iterable(parts)))
                # Every text is followed by an end, and an end stands before the first.
                upto = np.concatenate(([0], np.cumsum(known.length[numbers])))
                stops = upto[np.cumsum([len(p) for p in parts])]
                flat = np.insert(known.gather(numbers), np.concatenate(([0], stops)), 0)
                ends = stops + 1 + np.arange(len(stops))
                lines = [flat[low:min(low + step, end) + 1].tobytes()
                         for first, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)
                         for low in range(first, end, step)]
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["line"])

    return texts.select("text").mapInArrow(run, "line binary")


def pairs_in(lines: DataFrame) -> DataFrame:
    """``code, n`` over all of ``lines``: how often each class follows each, a pair of classes as one number."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            found = batch.column("line").to_pylist()
            flat = np.frombuffer(b"".join(found), np.int16).astype(np.int64)
            last = np.cumsum(np.array([len(line) // 2 for line in found], np.int64)) - 1
            codes = np.delete(flat[:-1] * CLASSES + flat[1:], last[:-1])
            pairs += np.bincount(codes, minlength=len(pairs))
        codes = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(pairs[codes], pa.int64())], ["code", "n"])

    return lines.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def class_pairs(texts: DataFrame, path: str, pattern: str, classes: np.ndarray) -> DataFrame:
    """``code, n`` over all of ``texts``."""
    return pairs_in(class_lines(texts, path, pattern, classes))


def windows_of(line: np.ndarray) -> np.ndarray:
    """Windows one after the other, in which every class of ``line`` but the first is a target once."""
    count = -(-(len(line) - 1) // attention.WINDOW)
    padded = np.full(count * attention.WINDOW + 1, -1, np.int64)
    padded[:len(line)] = line
    return padded[np.arange(count)[:, None] * attention.WINDOW + np.arange(attention.WINDOW + 1)]


def train_copies(lines: DataFrame, model: attention.Model, buckets: int) -> int:
    """Trains ``model`` on all windows of ``lines`` and returns their number.

    Lines are dealt into buckets by their content, equal ones by their number among equals, so that the buckets do
    not depend on partitions or identifiers. Each bucket trains a copy from the weights that ``model`` has; these
    become the mean of all copies, each counted by its windows. What reaches the driver is one set of weights.
    """
    known = lines.sparkSession.sparkContext.broadcast(model)

    def run(table: pa.Table) -> pa.Table:
        found = sorted(table.column("line").to_pylist())
        windows = np.concatenate([windows_of(np.frombuffer(line, np.int16)) for line in found])
        own = known.value.copied()
        own.train(windows, 1, rate=COPY_RATE)
        flat = own.flat()
        return pa.table({"place": pa.array(np.arange(len(flat)), pa.int32()),
                         "total": pa.array(flat * np.float64(len(windows)), pa.float64()),
                         "n": pa.array(np.full(len(flat), len(windows)), pa.int64())})

    copies = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).select(
        "line", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    dealt = copies.select("line", F.pmod(F.xxhash64("line", "copy"), F.lit(buckets)).alias("bucket"))
    mean = dealt.groupBy("bucket").applyInArrow(run, "place int, total double, n long").groupBy("place").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("place").toArrow()
    if not len(mean):
        return 0
    model.load(mean.column("total").to_numpy() / mean.column("n").to_numpy())
    return mean.column("n")[0].as_py()


class Fitted(NamedTuple):
    """What was learned: the model of classes, the class of each id, the log of each id's part of its class,
    and the counts of words."""

    model: attention.Model
    classes: np.ndarray
    within: np.ndarray
    counts: DataFrame


def fit(texts: DataFrame, texts_count: int, path: str, pattern: str) -> Fitted:
    """Counts over all of ``texts``, and weights trained on all of their windows; the same in every run."""
    cut = _subwords(path, pattern)
    counts = written(spelled(word_counts(texts), path, pattern), "lm-words")
    classes, often = classes_of(counts, cut.end + 1)
    often[cut.end] = texts_count
    ids = often + 0.5
    within = np.log(ids / np.bincount(classes, ids, CLASSES)[classes])
    lines = written(class_lines(texts, path, pattern, classes), "lm-lines")
    found = pairs_in(lines).toArrow()
    pairs = np.zeros(CLASSES * CLASSES)
    pairs[found.column("code").to_numpy()] = found.column("n").to_numpy()
    model = attention.Model(pairs.reshape(CLASSES, CLASSES))
    if windows := sample_windows(texts, path, pattern):
        length = attention.WINDOW + 1
        model.train(np.array([classes[w].tolist() + [-1] * (length - len(w)) for w in windows]),
                    max(2, min(20, VISITS // len(windows))))
    train_copies(lines, model, -(-int(pairs.sum()) // BUCKET_IDS) or 1)
    return Fitted(model, classes, within, counts.select("word", "n"))


class Scorer:
    """Scores texts; what it knows of a word is kept in arrays, so that a text is a few gathers from them."""

    def __init__(self, model: attention.Model, classes: np.ndarray, within: np.ndarray, path: str, pattern: str,
                 frequent: bytes, complete: bool) -> None:
        rows = pa.ipc.open_stream(frequent).read_all()
        self.count = dict(zip((w.encode() for w in rows.column("word").to_pylist()), rows.column("n").to_pylist(), strict=True))
        self.model, self.classes, self.within, self.complete = model, classes, within, complete
        self.cut = _subwords(path, pattern)
        self._forget()

    def _forget(self) -> None:
        self.word = Ragged(np.int16)
        self.names: list[bytes] = []
        # Of each word: log10(count + 1), the sum of its ids' parts of their classes, whether it is known, and
        # whether its count is still to be looked up.
        self.log_count, self.log_within = np.empty(0), np.empty(0)
        self.is_known, self.is_open = np.empty(0, bool), np.empty(0, bool)

    def _learn(self, new: list[bytes]) -> None:
        self.names += new
        ids = [self.cut.ids(w) for w in new]
        counts = [self.count.get(w) for w in new]
        flat = np.array([i for part in ids for i in part], np.int64)
        lengths = np.array([len(part) for part in ids], np.int64)
        ends = np.cumsum(lengths)
        sums = np.concatenate(([0.0], np.cumsum(self.within[flat])))
        self.word.add(new, lengths, self.classes[flat])
        self.log_within = np.concatenate((self.log_within, sums[ends] - sums[ends - lengths]))
        self.log_count = np.concatenate((self.log_count, np.log10([(c or 0) + 1 for c in counts])))
        self.is_known = np.concatenate((self.is_known, np.array([c is not None for c in counts], bool)))
        self.is_open = np.concatenate((self.is_open, np.array([c is None and not self.complete for c in counts], bool)))

    def block(self, texts: list[str]) -> Iterator[tuple]:
        """Per text: tokens, known ones, sum of log10(count + 1), score, and words to look up with their numbers."""
        cut = [words(t) for t in texts]
        if len(self.word) > GATHERED:
            self._forget()
        if new := self.word.missing(set().union(*cut)):
            self._learn(new)
        scores, pieces, starts, totals, at = [], [], [], [], 0
        back, step = attention.WINDOW - attention.STEP, attention.STEP
        numbers = self.word.numbers(list(itertools.chain.from_iterable(cut)))
        ends = np.cumsum([len(parts) for parts in cut])
        for parts, end in zip(cut, ends.tolist(), strict=True):
            number = numbers[end - len(parts):end]
            classes = self.word.gather(number)
            total = len(classes)
            count = -(-(total + 1) // step)
            line = np.full(back + 1 + count * step, -1, np.int16)
            line[:back + 1], line[back + 1:back + 1 + total], line[back + 1 + total] = 0, classes, 0
            pieces.append(line)
            starts.append(at + step * np.arange(count))
            totals.append(count)
            at += len(line)
            open_, times = np.unique(number[self.is_open[number]], return_counts=True)
            scores.append([len(parts) + 1, int(self.is_known[number].sum()), float(self.log_count[number].sum()),
                           float(self.log_within[number].sum()),
                           [(self.names[i].decode(), n) for i, n in zip(open_.tolist(), times.tolist(), strict=True)]])
        sums = self._windows(np.concatenate(pieces), np.concatenate(starts))
        ends = np.cumsum(totals)
        for row, total in zip(scores, np.add.reduceat(sums, ends - totals), strict=True):
            row[3] = (row[3] + float(total)) / np.log(10)
            yield tuple(row)

    def _windows(self, line: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The summed log-probability of each window's own ids."""
        back, span = attention.WINDOW - attention.STEP, np.arange(attention.WINDOW + 1)
        sums = np.empty(len(starts))
        for low in range(0, len(starts), SCORED):
            window = line[starts[low:low + SCORED, None] + span].astype(np.int64)
            sums[low:low + SCORED] = self.model.log_probability(
                np.maximum(window[:, :-1], 0), window[:, back + 1:], back).sum(axis=1)
        return sums


def score_texts(docs: DataFrame, learn, path: str, pattern: str, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``, whole texts.

    Learns from the rows that the condition ``learn`` selects. Tokens are the words and one end. ``base_score``
    sums log10((c + 1) / (N + V + 1)) with the token's count c, all tokens N and distinct ones V in the
    training rows; ``n_known`` tokens have c > 0. ``score`` is the model's log10 probability of the text with
    its end. Null text counts as empty: its one token is the end. With nothing to learn from, all counts are
    zero and the model is untrained. Repeated rows are scored one by one, null identifiers stay null, an
    empty table gives an empty result. Reruns agree.
    """
    context = docs.sparkSession.sparkContext
    chosen = docs.filter(F.coalesce(learn, F.lit(False)))
    learned = bounded_batches(chosen).select(or_blank(F.col(text_col)).alias("text"))
    learners = chosen.count()
    model, classes, within, listed = fit(learned, learners, path, pattern)
    size, total = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    train_tokens, distinct = total + learners, size + (learners > 0)
    frequent = most_frequent(listed, FREQUENT)
    known = context.broadcast((model, classes, within, path, pattern, arrow_bytes(frequent), size <= FREQUENT))

    def run(batches) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*known.value)
        for batch in batches:
            found = [row for block in blocks(batch.column("text").to_pylist()) for row in scorer.block(block)]
            *plain, open_words = list(zip(*found, strict=True)) or [[]] * 5
            pairs = [pair for row in open_words for pair in row]
            listed = pa.StructArray.from_arrays(
                [pa.array([w for w, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int64())], ["word", "times"])
            offsets = np.concatenate(([0], np.cumsum([len(row) for row in open_words]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(plain, kinds, strict=True)],
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), listed)], names)

    names = ["doc_id", "n_tokens", "n_known", "log_counts", "score", "open"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    texts = docs.select(F.col(id_col).alias("doc_id"), or_blank(F.col(text_col)).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    scored = written(texts.mapInArrow(
        run, f"doc_id {id_type}, n_tokens long, n_known long, log_counts double, score double, "
             "open array<struct<word: string, times: bigint>>").withColumn(
        "row", F.monotonically_increasing_id()), "lm-scored")

    # Counts of the words outside the broadcast table; a word that is not listed either has none.
    rare = scored.select("row", F.inline("open")).join(listed, "word").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_log"))
    ends = F.lit(float(np.log10(learners + 1)))
    floor = F.lit(float(np.log10(train_tokens + distinct + 1)))
    return scored.join(rare, "row", "left").select(
        "doc_id", "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0)) + F.lit(int(learners > 0))).cast("long").alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.coalesce("more_log", F.lit(0.0)) + ends - F.col("n_tokens") * floor).alias("base_score"),
        "score")
