"""Small tables with nulls, empty and very long texts, ties, repeated rows and clashing column names."""

import collections
import hashlib
import math
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm import ann, byte_bpe, exact_dedup, language, lm_scoring, mixing, simhash, token_counts, url_filter

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
LONG = "".join(f"word{i} and the next one, " for i in range(20_000))
TEXTS = [
    (1, "The same Text.", "en", "a"), (2, "the same text.", "en", "b"), (3, "THE SAME TEXT.", None, None),
    (4, None, "en", "a"), (5, "", "fr", "b"), (6, " \t\n ", "fr", "c"), (7, "ÄÖ äö", "de", "c"), (7, "ÄÖ äö", "de", "c"),
    (8, LONG, "en", "a"), (9, "x" * 5000, "en", "d"), (10, "un deux trois quatre", "fr", None),
    (11, "one <|endoftext|> two's  three\u2003four\u00a0\n\n five", "en", "d"), (None, "no identifier here", "en", "a"),
    (None, None, None, None), (12, "12 345 !?", "en", "e"), (13, "emoji \U0001f600\U0001f600 ok", None, "e")]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text) if w]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns named as the operators name their own."""
    extra = "digest string, content string, ident long, row long, size long, fp long, copies long, word string, n long"
    return spark.createDataFrame(
        [(*row, *["clash", "clash", 0, 0, 0, 0, 0, "clash", 0]) for row in TEXTS],
        f"doc_id long, text string, lang string, source string, {extra}").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def test_exact_dedup(docs):
    groups = collections.defaultdict(list)
    for i, text, _, _ in TEXTS:
        groups[lowered(text)].append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    want = collections.Counter(
        (i, max((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for i in ids)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    # One row of each group stays, of rows repeated with one identifier too.
    assert sum(r.kept for r in got) == len(groups)
    assert {r.doc_id for r in got if r.kept} >= {3, 7, 8, 9}


def test_exact_dedup_compares_bytes_behind_a_weak_digest(docs):
    def weak(content):
        return F.unhex(F.lpad(F.hex(F.length(content) % 3), 8, "0"))

    strong = exact_dedup.exact_dedup(docs).drop("digest")
    found = exact_dedup.exact_dedup(docs, digest=weak, files_per_batch=1).drop("digest")
    assert collections.Counter(map(tuple, found.drop("kept").collect())) == collections.Counter(
        map(tuple, strong.drop("kept").collect()))
    assert found.filter("kept").count() == strong.filter("kept").count()


def test_empty_tables(spark, docs, none):
    assert exact_dedup.exact_dedup(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert language.identify(none, F.lit(True)).count() == 0
    assert token_counts.count_tokens(none, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    assert byte_bpe.encode(none, RANKS, P.PATTERN).count() == 0
    assert lm_scoring.score_texts(none, F.lit(True), RANKS, P.PATTERN).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest_neighbours(vectors, F.lit(True)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_pages(pages, url_filter.rule_table(spark)).count() == 0


def fits(host, path, rule):
    return (host == rule[0] or host.endswith("." + rule[0])) and path.startswith(rule[1])


def test_url_filter(spark):
    urls = [None, "", "no scheme/en/", "http://net", "http://net/", "HTTP://A.NET/x?y", "http://b.example.net/en/1", "x://.net/",
            "http://example.net/en", "http://net:80/", "ftp://q.org/fr/?z", "http://example.com/de/#t", "http://anet/",
            "http://a://b.net/", "http://" + "a." * 5000 + "net/" + "p" * 9000, "http://x.net/en/", "http://x.net/en/"]
    rules = [*url_filter.RULES, ("x.net", "/e", "allow"), ("x.net", "/e", "block"), (None, "/", "block"), ("net", "", "allow")]
    pages = spark.createDataFrame([(i % 9, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = collections.Counter(map(tuple, url_filter.filter_pages(pages, url_filter.rule_table(spark, rules)).collect()))
    want = collections.Counter()
    for i, url in enumerate(urls):
        rest = (url or "").partition("://")[2]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = lowered(rest[:cut]), re.split("[?#]", rest[cut:])[0]
        best = sorted((-len(h + p), -len(h), h + p, {"block": 0, "allow": 1}[v]) for h, p, v in rules
                      if h and fits(host, path, (h, p)))
        rule = best[0][2] if best else None
        verdicts = {v for h, p, v in rules if h and h + p == rule}
        verdict = ("block" if "block" in verdicts else "allow") if best else "allow"
        want[i % 9, host, path, rule, verdict] += 1
    assert got == want
    assert url_filter.filter_pages(pages, url_filter.rule_table(spark).filter("false")).filter("verdict = 'allow'").count() == len(urls)


def test_byte_bpe(docs):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    want = collections.Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t, _, _ in TEXTS)
    found = byte_bpe.encode(docs, RANKS, P.PATTERN).withColumn("back", byte_bpe.decoded("ids", RANKS)).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in found) == want
    assert collections.Counter(bytes(r.back).decode() for r in found) == collections.Counter(t or "" for _, t, _, _ in TEXTS)


def test_byte_bpe_folds_what_is_not_frequent(docs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "FREQUENT", 20)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    few = docs.filter("length(text) < 1000")
    want = collections.Counter((i, tuple(library.encode_ordinary(t))) for i, t, _, _ in TEXTS if t is not None and len(t) < 1000)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in byte_bpe.encode(few, RANKS, P.PATTERN).collect()) == want


def test_token_counts(docs):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, text, _, _ in TEXTS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[i, len((text or "").encode()), n, n > 512] += 1
    got = token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert collections.Counter(map(tuple, got)) == want


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    sizes = [len(split(t or "")) for _, t, _, _ in TEXTS]
    assert collections.Counter((r.doc_id, r["size"]) for r in rows) == collections.Counter(
        (t[0], n) for t, n in zip(TEXTS, sizes, strict=True))
    by_source = collections.defaultdict(int)
    for (_, _, _, s), n in zip(TEXTS, sizes, strict=True):
        by_source[s] += n
    # Targets by filling sources up to twice their size, the rest going on by weight.
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight, left, fixed = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        level = (left - sum(fixed.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * by_source[s]]
        if not over:
            break
        fixed.update((s, 2.0 * by_source[s]) for s in over)
    target = {s: fixed.get(s, weight[s] * level) for s in order}
    taken = collections.defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == by_source[r.source]
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max([n for t, n in zip(TEXTS, sizes, strict=True) if t[3] == s])
    assert collections.Counter(map(tuple, rows)) == collections.Counter(map(tuple, mixing.mix(docs.repartition(5)).collect()))


def brute_fingerprint(text):
    words = split(lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints(docs):
    got = simhash.near_duplicates(docs).collect()
    assert collections.Counter((r.doc_id, r.fp % 2 ** 64) for r in got) == collections.Counter(
        (i, brute_fingerprint(t)) for i, t, _, _ in TEXTS)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in got if r.doc_id in (4, 5, 6)} == {4}


def reachable(fps, distance):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if bin((a ^ fps[j]) % 2 ** 64).count("1") <= distance:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("crowd", [0, 64])
def test_simhash_links_lose_no_pair(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(5)
    centres = rng.integers(-2 ** 63, 2 ** 63, 6).tolist()
    fps = sorted({c ^ int(sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 5))))) - (0 if c >= 0 else 0)
                  for c in centres for _ in range(40)} | set(centres))
    fps = [(f + 2 ** 63) % 2 ** 64 - 2 ** 63 for f in fps]
    roots = reachable(fps, 3)
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    from newsloom.llm.components import components
    found = {r.node: r.root for r in components(links).collect()}
    want = collections.defaultdict(set)
    got = collections.defaultdict(set)
    for f, r in zip(fps, roots, strict=True):
        want[r].add(f)
        got[found.get(f, f)].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_language(spark, docs):
    rows = [(i, t * 3, "en" if i % 2 else "fr", "clash") for i, t in enumerate(
        ["le chat est sur la table et il mange ", "the cat is on the table and it eats "] * 20)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    learn = learn.unionByName(spark.createDataFrame([(99, "la table est sur le chat", None, "clash")], learn.schema))
    asked = learn.select("doc_id", "text", "lang").unionByName(docs.filter("doc_id >= 4 OR doc_id IS NULL").select(
        (F.col("doc_id") + 100).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang")))
    got = {(r.doc_id, r.lang_pred): r.score for r in language.identify(asked, F.lit(True)).collect()}
    assert all((i, lang) in got for i, _, lang, _ in rows)
    assert all(0 <= s <= 1 for s in got.values())
    for i in (104, 105, 106, 112):
        assert got[i, "und"] == 0
    assert (99, "fr") in got
    untaught = language.identify(asked, F.lit(False)).collect()
    assert {r.lang_pred for r in untaught} == {"und"}


def test_language_distance_by_hand():
    judge = language.Judge([("aa", ord("a"), 1), ("aa", ord("b"), 2), ("bb", ord("b"), 1)])
    text = "b a b"
    own = [int(g) for g in np.concatenate([language.grams("a"), language.grams("b")])]
    counts = collections.Counter({g: (1 if i < len(own) // 2 else 2) for i, g in enumerate(own)})
    ranked = sorted(counts, key=lambda g: (-counts[g], g))
    distance = {}
    for lang, places in (("aa", {ord("a"): 0, ord("b"): 1}), ("bb", {ord("b"): 0})):
        distance[lang] = sum(abs(places[g] - i) if g in places else language.PROFILE for i, g in enumerate(ranked))
    best = min(distance, key=lambda lang: (distance[lang], lang))
    assert judge.judge(text) == (best, 1 - distance[best] / (language.PROFILE * len(ranked)))


def test_lm_scoring(docs):
    learn = F.col("doc_id") % 3 != 0
    rows = lm_scoring.score_texts(docs, learn, RANKS, P.PATTERN).collect()
    cut = {i: [*lowered(t).encode().split(), None] for i, (_, t, _, _) in enumerate(TEXTS)}
    counts = collections.Counter()
    for i, (doc_id, *_) in enumerate(TEXTS):
        if doc_id is not None and doc_id % 3:
            counts.update(cut[i])
    total, distinct = sum(counts.values()), len(counts)
    want = collections.Counter((TEXTS[i][0], len(c), sum(counts[w] > 0 for w in c), total, round(
        sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in c), 6)) for i, c in cut.items())
    assert collections.Counter(
        (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 for r in rows)


def test_lm_probabilities_add_up():
    from newsloom.llm import attention
    rng = np.random.default_rng(3)
    model = attention.Model(rng.integers(0, 9, (300, 300)).astype(float))
    model.train(rng.integers(0, 300, (50, attention.WINDOW + 1)), epochs=1)
    window = np.repeat(rng.integers(0, 300, (1, attention.WINDOW)), 300, axis=0)
    targets = np.full((300, 1), 0)
    targets[:, 0] = np.arange(300)
    log_p = model.log_probability(window, targets, attention.WINDOW - 1)
    assert np.exp(log_p).sum() == pytest.approx(1, abs=1e-4)


def test_attention_gradients():
    from newsloom.llm import attention
    rng = np.random.default_rng(4)
    model = attention.Model(rng.integers(0, 9, (150, 150)).astype(float))
    model.weights = {n: w.astype(np.float64) for n, w in model.weights.items()}
    windows = rng.integers(0, 150, (3, 7))
    windows[1, 5:] = -1

    def loss():
        targets = windows[:, 1:]
        return -model.log_probability(np.maximum(windows[:, :-1], 0), targets, 0).sum() / (targets >= 0).sum()

    grads = model._gradients(windows)
    for name, weight in model.weights.items():
        at = tuple(int(rng.integers(0, min(n, 5))) for n in weight.shape)
        at = (int(windows[0, 0]), at[1]) if name == "token" else at
        old, step = weight[at], 1e-3
        weight[at] = old + step
        up = loss()
        weight[at] = old - step
        down = loss()
        weight[at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(120)]
    rows += [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (None, [1.0] * 6),
             (204, [float("inf")] * 6), (205, [1.0, 2.0]), (150, rows[50][1]), (151, rows[50][1]), (152, rows[50][1]), (5, rows[5][1])]
    vectors = spark.createDataFrame(
        [(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, entry long")
    got = collections.defaultdict(list)
    for r in ann.nearest_neighbours(vectors, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    usable = {i: np.array(v) for i, v in rows if i is not None and v and len(v) == 6
              and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    want = {}
    for q in (i for i in usable if i % 50 == 0):
        scores = [(-round(float(usable[q] @ v / np.sqrt((usable[q] @ usable[q]) * (v @ v))), 9), i) for i, v in usable.items() if i != q]
        want[q] = [(i, -s) for s, i in sorted(scores)[:5]]
    assert {q: [(i, pytest.approx(s)) for i, s in found] for q, found in got.items()} == want


def test_digest_columns_are_of_whole_texts(spark):
    from newsloom.llm.queries import REGISTRY
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in REGISTRY.queries["op4_byte_bpe"](spark, folder).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
