"""The language model against a plain forward pass, and what it learns from the corpus."""

import collections

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from newsloom.llm import attention, lm_scoring

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def log_softmax(x):
    x = np.asarray(x, np.float64)
    return x - x.max() - np.log(np.exp(x - x.max()).sum())


def plain_log10(fitted, ids, end):
    """One id at a time: the causal window before it, one head, then the levels of the output."""
    model, w = fitted.model, {n: v.astype(np.float64) for n, v in fitted.model.weights.items()}
    overlap = attention.WINDOW - attention.STEP
    line = [end] * (overlap + 1) + ids + [end]
    total = 0.0
    for at in range(overlap + 1, len(line)):
        first = (at - overlap - 1) // attention.STEP * attention.STEP
        seen = fitted.classes[line[first:at]]
        x = w["token"][seen] + w["place"][:len(seen)]
        pull = (x @ w["key"]) @ (x[-1] @ w["query"]) / np.sqrt(attention.WIDTH)
        read = np.tanh(np.exp(log_softmax(pull)) @ (x @ w["value"]))
        wanted = fitted.classes[line[at]]
        total += log_softmax(model.bigram[0][seen[-1]] + read @ w["out0"])[model.symbol[wanted]]
        for i, (low, high) in enumerate(attention.bands(len(model.symbol)), 1):
            if low <= wanted < high:
                total += log_softmax(model.bigram[i][seen[-1]] + read @ w[f"out{i}"])[wanted - low]
        total += fitted.within[line[at]]
    return total / np.log(10)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").filter("length(text) < 3000")


def test_score_is_that_of_a_plain_forward_pass(docs):
    learn = F.col("doc_id") % 3 != 0
    learned = docs.filter(learn).select(F.coalesce("text", F.lit("")).alias("text"))
    fitted = lm_scoring.fit(learned, learned.count(), RANKS, P.PATTERN)
    cut = lm_scoring.Subwords(RANKS, P.PATTERN)
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = {r.doc_id: r.score for r in lm_scoring.score_texts(docs, learn, RANKS, P.PATTERN).collect()}
    assert scores.keys() == texts.keys()
    for doc_id, text in list(texts.items())[:40]:
        ids = [i for word in lm_scoring.words(text or "") for i in cut.ids(word)]
        assert scores[doc_id] == pytest.approx(plain_log10(fitted, ids, cut.end), rel=1e-4)


def test_counts_of_ids_and_pairs_are_of_the_whole_corpus(docs):
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    cut = lm_scoring.Subwords(RANKS, P.PATTERN)
    words = lm_scoring.spelled(lm_scoring.word_counts(texts), RANKS, P.PATTERN)
    classes, often = lm_scoring.classes_of(words, cut.end + 1)
    ids, pairs = collections.Counter(), collections.Counter()
    for r in texts.collect():
        found = [i for word in lm_scoring.words(r.text) for i in cut.ids(word)]
        ids.update(found)
        line = [0, *classes[found].tolist(), 0]
        pairs.update(a * lm_scoring.CLASSES + b for a, b in zip(line, line[1:], strict=False))
    assert {i: n for i, n in enumerate(often.tolist()) if n} == dict(ids)
    got = lm_scoring.class_pairs(texts, RANKS, P.PATTERN, classes).collect()
    assert {r.code: r.n for r in got} == dict(pairs)
    # The most frequent ids have a class of their own; every other one that occurs is in a group.
    own = lm_scoring.CLASSES - lm_scoring.GROUPS
    frequent = [i for i, _ in sorted(ids.items(), key=lambda e: (-e[1], e[0]))]
    assert classes[frequent[:own - 1]].tolist() == list(range(1, own))
    assert (classes[frequent[own - 1:]] >= own).all()


def test_sample_does_not_depend_on_identifiers_or_copies(spark, docs):
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    once = lm_scoring.sample_windows(texts, RANKS, P.PATTERN)
    again = lm_scoring.sample_windows(texts.union(texts).union(texts).repartition(7), RANKS, P.PATTERN)
    assert once == again


def test_reruns_agree_where_identifiers_are_null(docs):
    blank = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    learn = F.col("doc_id").isNull()
    runs = [sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in lm_scoring.score_texts(
        blank.repartition(parts), learn, RANKS, P.PATTERN).collect()) for parts in (2, 5)]
    assert [r[:2] for r in runs[0]] == [r[:2] for r in runs[1]]
    assert [r[2] for r in runs[0]] == pytest.approx([r[2] for r in runs[1]], rel=1e-5)


def learned_lines(docs):
    """The texts, their classes and the classes of each text between two ends, one id at a time."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    cut = lm_scoring.Subwords(RANKS, P.PATTERN)
    words = lm_scoring.spelled(lm_scoring.word_counts(texts), RANKS, P.PATTERN)
    classes, _ = lm_scoring.classes_of(words, cut.end + 1)
    found = [[i for word in lm_scoring.words(r.text) for i in cut.ids(word)] for r in texts.collect()]
    return texts, classes, [[0, *classes[ids].tolist(), 0] for ids in found]


def test_weights_come_from_all_windows(docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "sample_windows", lambda *_: [])
    texts, classes, lines = learned_lines(docs)
    size = attention.WINDOW
    windows = []
    for line in sorted(lines, key=lambda line: np.array(line, np.int16).tobytes()):
        for low in range(0, len(line) - 1, size):
            part = line[low:low + size + 1]
            windows.append(part + [-1] * (size + 1 - len(part)))
    fitted = lm_scoring.fit(texts, texts.count(), RANKS, P.PATTERN)
    pairs = collections.Counter((a, b) for line in lines for a, b in zip(line, line[1:], strict=False))
    counts = np.zeros((lm_scoring.CLASSES, lm_scoring.CLASSES))
    for at, n in pairs.items():
        counts[at] = n
    plain = attention.Model(counts)
    plain.train(np.array(windows), 1, rate=lm_scoring.COPY_RATE)
    for name, weight in plain.weights.items():
        assert fitted.model.weights[name] == pytest.approx(weight, abs=2e-4)


def test_every_window_is_in_one_bucket(docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PIECE_WINDOWS", 2)
    texts, classes, lines = learned_lines(docs)
    twice = texts.union(texts)
    dealt = lm_scoring.class_lines(twice, RANKS, P.PATTERN, classes)
    model = attention.Model(np.ones((lm_scoring.CLASSES, lm_scoring.CLASSES)))
    before = model.flat()
    assert lm_scoring.train_copies(dealt, model, 5) == 2 * sum(-(-(len(line) - 1) // attention.WINDOW) for line in lines)
    other = attention.Model(np.ones((lm_scoring.CLASSES, lm_scoring.CLASSES)))
    lm_scoring.train_copies(lm_scoring.class_lines(twice.repartition(3), RANKS, P.PATTERN, classes), other, 5)
    assert model.flat() == pytest.approx(other.flat(), abs=1e-6)
    assert np.abs(model.flat() - before).max() > 1e-3
