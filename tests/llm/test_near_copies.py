"""The pipeline's near-dedup stage against a brute-force Jaccard version."""

import collections
import random

import corpus_pipeline
import pytest
from test_edge_cases import split

from newsloom.llm import near_copies, simhash


def shingles(text):
    words = split(text)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def staying(rows):
    """rows: (identifier, text). The smallest identifier of each component of pairs of Jaccard 0.8 or more."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_shingle = collections.defaultdict(list)
    for i, found in enumerate(sets):
        for s in found:
            by_shingle[s].append(i)
    pairs = {(i, j) for met in by_shingle.values() for i in met for j in met if i < j}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (ident, _) in enumerate(rows):
        least[find(i)] = min(ident, least.get(find(i), ident))
    return sorted(least.values())


def copies(rng):
    """Texts with copies of one to nine edits of 300 words, a crowd of copies of one text, and texts that share half."""
    rows, half = [], [f"w{rng.randrange(5000)}" for _ in range(150)]
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append(words)
        for edits in range(1, 10):
            copy = list(words)
            for at in rng.sample(range(300), edits):
                copy[at] += "x"
            rows.append(copy)
    for _ in range(90):
        copy = list(rows[0])
        for at in rng.sample(range(300), 5):
            copy[at] += f"y{rng.randrange(100)}"
        rows.append(copy)
    rows += [half + [f"w{rng.randrange(5000)}" for _ in range(150)] for _ in range(60)]
    rows += [["one", "two"], ["one", "two", "three"]]
    return [(i, " ".join(words)) for i, words in enumerate(rows)]


@pytest.mark.parametrize("crowd", [near_copies.CROWD, 2])
def test_stage_is_brute_force_jaccard(spark, small, monkeypatch, crowd):
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    given = spark.read.parquet(f"{small}/documents.parquet").collect()
    rows = list({t.lower(): (10000 + r.doc_id, t) for r in given if (t := r.text or "").split()}.values())
    rows += copies(random.Random(3))
    docs = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.drop_near_copies(spark, docs, small)
    assert sorted(r.doc_id for r in found.collect()) == staying(rows)


def test_fingerprints_alone_find_the_nearest_copies(spark, small, monkeypatch):
    """Without the MinHash candidates, copies whose SimHash differs in three bits at most are found; pairs are verified."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(words[:200])), (4, "alone here")]
    fps = [near_copies.signature(t)[1] for _, t in rows]
    assert fps == [simhash.fingerprint(t, 5) for _, t in rows] and (fps[0] ^ fps[1]).bit_count() <= 3
    monkeypatch.setattr(near_copies, "_met", lambda left, right, on: spark.createDataFrame([], "a long, b long"))
    docs = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.drop_near_copies(spark, docs, small)
    assert sorted(r.doc_id for r in found.collect()) == [1, 3, 4]


def test_pairs_of_fingerprints(spark):
    rows = spark.createDataFrame(enumerate([5, 5, 5 ^ 7, 5 ^ 15 << 10, -1]), "key long, fp long")
    found = near_copies._fingerprint_pairs(rows).collect()
    assert sorted(map(tuple, found)) == [(0, 1), (0, 2)]


def test_pairs_of_a_crowd_do_not_grow_with_its_square(spark, small, monkeypatch):
    """Copies of one text with one to nine words less or changed: most pairs share a segment, many below the similarity."""
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(1, 10)):
            at = rng.randrange(len(words))
            words[at:at + 1] = [] if rng.random() < 0.5 else [f"{words[at]}x{rng.randrange(1000)}"]
        rows.append((i, " ".join(words)))
    verified, links = [], near_copies._links
    monkeypatch.setattr(near_copies, "_links", lambda pairs, shingles: verified.append(pairs.count()) or links(pairs, shingles))
    docs = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.drop_near_copies(spark, docs, small)
    assert sorted(r.doc_id for r in found.collect()) == staying(rows)
    assert len(verified) == 2 and verified[1] < 4 * len(rows)


def joined_rows(frame):
    """The most rows that a join of the plan that ``frame`` ran has made."""
    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        rows = node.metrics().get("numOutputRows")
        below = [walk(node.children().apply(i)) for i in range(node.children().size())]
        return max([rows.get().value() if "Join" in kind and rows.isDefined() else 0, *below])

    frame.collect()
    return walk(frame._jdf.queryExecution().executedPlan())


def test_a_crowd_meets_in_few_pairs(spark, small, monkeypatch):
    """Copies of one text with a few words replaced: no join makes as many rows as ten for each text."""
    rng, taken, links = random.Random(8), [], near_copies._links
    monkeypatch.setattr(near_copies, "_links", lambda pairs, shingles: taken.append(pairs) or links(pairs, shingles))
    rows = []
    for i in range(500):
        words = [f"w{j}" for j in range(150)]
        for at in rng.sample(range(150), rng.randrange(2, 10)):
            words[at] = f"x{rng.randrange(20)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.drop_near_copies(spark, docs, small)
    assert sorted(r.doc_id for r in found.collect()) == staying(rows)
    assert joined_rows(taken[1]) < 10 * len(rows)
