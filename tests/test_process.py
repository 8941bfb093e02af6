"""Quality rules, dedup, reply decoding and routing on literal rows."""

import itertools
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsloom.operators import annotate as N
from newsloom.operators import dedup as D
from newsloom.operators import quality as Q
from newsloom.plans import process as P
from newsloom.profiles import PROFILE_A, PROFILE_B
from newsloom.schemas import RAW_ARTICLE, RESPONSE

SCHEMA = "seq long, date string, headline string, content string, article_url string, source_url string"


def articles(spark, *rows):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], SCHEMA)


QUALITY = [
    ("", "A" * 200, None, "u",
     (200, 1, 0, 2, "adequate_length poor_structure non_technical has_url"),
     (200, 1, 0, 0, "very_short poor_structure low_relevance no_headline")),
    ("Short", ("x" * 199 + ".") * 5, "2025-01-01", "u",
     (1000, 5, 0, 6, "excellent_length good_structure non_technical has_date has_url"),
     (1000, 5, 0, 4, "moderate_length basic_structure low_relevance basic_headline")),
    ("A headline of length>20", "TSMC Intel AMD NVIDIA AI GPU CPU", None, None,
     (32, 1, 0, 0, "insufficient_length poor_structure non_technical"),
     (32, 1, 0, 2, "very_short poor_structure low_relevance good_headline")),
    ("h", "microprocessor fabrication. " * 40, "2025-01-01", None,
     (1120, 40, 3, 8, "excellent_length excellent_structure technical_content has_date"),
     (1120, 40, 2, 8, "sufficient_length well_structured relevant basic_headline")),
    ("h", "a..b. .c.", None, None,
     (9, 3, 0, 1, "insufficient_length good_structure non_technical"),
     (9, 3, 0, 2, "very_short basic_structure low_relevance basic_headline")),
    ("h", " \n ", None, None,
     (3, 0, 0, 0, "insufficient_length poor_structure non_technical"),
     (3, 0, 0, 1, "very_short poor_structure low_relevance basic_headline")),
]


@pytest.mark.parametrize("profile,place", [(PROFILE_A, 4), (PROFILE_B, 5)])
def test_quality(spark, profile, place):
    rows = articles(spark, *[(date, head, text, url, "s") for head, text, date, url, *_ in QUALITY])
    got = [(r.content_length, r.sentence_count, r.tech_keyword_count, r.quality_score, " ".join(r.quality_factors))
           for r in Q.assess(rows, profile).orderBy("seq").collect()]
    assert got == [q[place] for q in QUALITY]


def test_casefolded_keywords_match(spark):
    rows = articles(spark, (None, "h", "TSMC Intel AMD NVIDIA AI GPU CPU", None, None))
    assert Q.assess(rows, PROFILE_A, casefold_keywords=True).first().tech_keyword_count == 5


def test_usable_bounds(spark):
    rows = articles(
        spark, (None, "h", " " + "x" * 200, None, None), (None, "h", "x" * 199 + "  ", None, None),
        (None, " ", "x" * 300, None, None), (None, None, "x" * 300, None, None), (None, "h", None, None, None))
    kept = rows.filter(Q.usable(F.col("content"), F.col("headline")))
    assert [r.seq for r in kept.collect()] == [0]


def test_dedup_profiles(spark):
    rows = articles(
        spark, (None, "x", "Hello   World", None, None), (None, "y", " hello\nworld ", None, None),
        (None, "z", "", None, None), (None, "z", "", None, None), (None, "z", None, None, None),
        (None, "w", " \n ", None, None))
    a = {r.seq: r.content_hash for r in D.deduplicate(rows, PROFILE_A).collect()}
    assert a == {0: "5eb63bbbe01eeed093cb22bb8f5acdc3", 5: "d41d8cd98f00b204e9800998ecf8427e"}
    assert sorted(r.seq for r in D.deduplicate(rows, PROFILE_B).collect()) == [0, 1, 2, 5]
    assert D.duplicate_counts(rows, PROFILE_A).first().asDict() == {
        "loaded": 6, "empty_dropped": 3, "unique_count": 2, "duplicate_count": 1}
    assert D.duplicate_counts(rows, PROFILE_B).first().asDict() == {
        "loaded": 6, "empty_dropped": 0, "unique_count": 4, "duplicate_count": 2}
    assert [r.seq for r in D.duplicate_report(rows, PROFILE_A).collect()] == [1]


def envelope(text):
    return json.dumps({"choices": [{"message": {"content": text}}]}, ensure_ascii=False)


GOOD = '{"sentiment":"利好","summary":"s","relevant":"是"}'


def reply(**changes):
    return json.dumps({"sentiment": "利好", "summary": "s", "relevant": "是", **changes}, ensure_ascii=False)


# body, status, outcome in A, outcome in B
REPLIES = [
    (envelope(GOOD), 200, "ok", "ok"),
    (envelope("Sure:\n```json\n" + GOOD + "\n```"), 200, "ok", "stop"),
    (envelope(GOOD + " junk"), 200, "ok", "stop"),
    (envelope(GOOD + GOOD), 200, "next", "stop"),
    (envelope(reply(sentiment="positive")), 200, "next", "ok"),
    (envelope(reply(summary="None")), 200, "next", "ok"),
    (envelope(reply(summary="  ")), 200, "next", "ok"),
    (envelope(reply(summary=None)), 200, "next", "ok"),
    (envelope(reply(summary=5)), 200, "stop", "ok"),
    (envelope('{"sentiment":"利好","summary":"s"}'), 200, "next", "stop"),
    (GOOD, 200, "ok", "error"),
    (envelope("no braces"), 200, "next", "stop"),
    (envelope("5"), 200, "next", "error"),
    (envelope("[1]"), 200, "next", "stop"),
    ('{"choices":[]}', 200, "next", "error"),
    ('{"choices":[{"text":"x"}]}', 200, "stop", "error"),
    ('{"choices":[{"message":{"content":null}}]}', 200, "stop", "error"),
    ('{"other":1}', 200, "next", "error"),
    ("", 200, "stop", "next"),
    ("  ", 200, "stop", "next"),
    ("oops", 200, "stop", "next"),
    (envelope(GOOD), 500, "next", "next"),
    (envelope(GOOD), 302, "ok", "next"),
    (None, None, "next", "next"),
]


@pytest.mark.parametrize("profile,place", [(PROFILE_A, 2), (PROFILE_B, 3)])
def test_reply_decoding(spark, profile, place):
    rows = spark.createDataFrame([(i, 1, r[1], r[0]) for i, r in enumerate(REPLIES)], RESPONSE)
    got = {r.seq: r.kind for r in N.decode_replies(rows, profile).collect()}
    assert not [(REPLIES[i][0], kind) for i, kind in got.items() if kind != REPLIES[i][place]]


def test_error_messages(spark):
    rows = spark.createDataFrame([(i, 1, r[1], r[0]) for i, r in enumerate(REPLIES)], RESPONSE)
    got = {REPLIES[r.seq][0]: r.error_text
           for r in N.decode_replies(rows, PROFILE_B).filter("kind = 'error'").collect()}
    assert got[GOOD] == "'choices'" and got['{"choices":[]}'] == "list index out of range"
    assert got[envelope("5")] == "argument of type 'int' is not iterable"
    assert got['{"choices":[{"message":{"content":null}}]}'] == "'NoneType' object has no attribute 'strip'"


def test_fold_attempts_against_a_loop(spark):
    source = random.Random(5)
    rows, expected = [], {}
    for seq in range(300):
        kinds = [source.choice(["ok", "next", "stop", "error"]) for _ in range(source.randrange(1, 4))]
        rows += [(seq, i + 1, k, f"v{i}", "s", "r", "e" if k == "error" else None) for i, k in enumerate(kinds)]
        settled = [(k, i) for i, k in enumerate(kinds[:2]) if k != "next"]
        if settled:
            expected[seq] = (settled[0][0], f"v{settled[0][1]}")
    frame = spark.createDataFrame(
        rows, "seq long, attempt int, kind string, sentiment string, summary string, relevant string, error_text string")
    got = {r.seq: (r.outcome, r.reply_sentiment) for r in N.fold_attempts(frame, 2).collect()}
    assert got == expected


def test_routing_every_status(spark):
    text = "microprocessor fabrication. " * 40
    rows = articles(spark, (None, "h1", "", None, None), (None, "h2", "ab", None, None), (None, "h3", text, None, None),
                    (None, "h4", text, None, None), (None, "h5", text, None, None), (None, "h6", None, None, None))
    replies = spark.createDataFrame([(2, 1, 200, envelope(GOOD)), (3, 1, 200, "{}"), (4, 1, 200, "junk")], RESPONSE)
    got = {r.headline: r for r in P.process(rows, replies, PROFILE_B, null_is_error=True).collect()}
    assert {h: (r.processing_status, r.sentiment, r.summary, r.relevant) for h, r in got.items()} == {
        "h1": ("no_content", "中立", "无内容可供分析", "否"),
        "h2": ("low_quality", "中立", "文章质量过低，跳过分析", "否"),
        "h3": ("success", "利好", "s", "是"),
        "h4": ("error", "中立", "处理错误: 'choices'", "否"),
        "h5": ("failed", "中立", "LLM分析失败", "否"),
        "h6": ("error", "中立", "处理错误: object of type 'NoneType' has no len()", "否"),
    }
    assert got["h4"].quality_score is None and got["h2"].quality_score == 1
    summary = P.run_summary(rows, replies, PROFILE_B, null_is_error=True).first()
    assert (summary.loaded, summary.unique_count, summary.success_count, summary.failed_count) == (6, 6, 1, 1)
    assert summary.avg_quality == pytest.approx((1 + 1 + 8 + 8 + 0 + 0) / 6)


def test_empty_input_summary(spark):
    empty = spark.createDataFrame([], RAW_ARTICLE).withColumn("seq", F.lit(0).cast("long"))
    row = P.run_summary(empty, spark.createDataFrame([], RESPONSE), PROFILE_A).first().asDict()
    assert set(row.values()) == {0}


def test_scorer_sees_only_gated_texts(spark):
    seen = spark.sparkContext.accumulator(0)

    def scorer(texts: pd.Series) -> pd.DataFrame:
        seen.add(len(texts))
        answers = pd.DataFrame({"sentiment": "利好", "summary": texts.str[:3], "relevant": "是"}, index=texts.index)
        answers.loc[texts.str.startswith("silent"), ["sentiment", "summary", "relevant"]] = None
        return answers

    long = "fabrication. " * 100
    rows = articles(spark, (None, "h1", "short", None, None), (None, "h2", long, None, None),
                    (None, "h3", "silent " + long, None, None), (None, "h4", long, None, None))
    got = {r.headline: (r.processing_status, r.summary)
           for r in P.process_with_scorer(rows, scorer, PROFILE_A, concurrency=2).collect()}
    assert got == {"h1": ("low_quality", "文章质量过低，跳过分析"), "h2": ("success", "fab"),
                   "h3": ("failed", "LLM分析失败")}
    assert seen.value == 2


def test_request_bodies(spark):
    row = spark.createDataFrame([('say "hi"\n中',)], "content string").select(
        N.request_body(F.col("content"), "m", PROFILE_A, "s1").alias("a"),
        N.request_body(F.col("content"), "m", PROFILE_B).alias("b")).first()
    a, b = json.loads(row.a), json.loads(row.b)
    assert [m["role"] for m in a["messages"]] == ["system", "user"] and a["messages"][1]["content"] == 'say "hi"\n中'
    assert (a["temperature"], a["preset"], a["session_id"], a["model"]) == (0.2, True, "s1", "m")
    assert (b["max_tokens"], b["temperature"]) == (500, 0.3) and 'say "hi"\n中' in b["messages"][0]["content"]


def test_labels(spark):
    rows = spark.createDataFrame([(c,) for c in ["利好", "中立", "利弊", "是", "否", "x"]], "c string")
    assert [r[0] for r in rows.select(N.english_label(F.col("c"))).collect()] == [
        "positive", "neutral", "negative", "yes", "no", "x"]


def test_random_dedup_against_dictionary(spark):
    source = random.Random(11)
    words = ["Alpha", "alpha ", "beta\n", " BETA", "", " ", "gamma.", "alpha beta", "Alpha  Beta"]
    rows = [(None, source.choice("xy"), source.choice(words), None, None) for _ in range(400)]
    seen, kept = set(), []
    for i, row in enumerate(rows):
        key = " ".join(row[2].lower().split())
        if row[2] and key not in seen:
            seen.add(key)
            kept.append(i)
    got = sorted(r.seq for r in D.deduplicate(articles(spark, *rows), PROFILE_A).collect())
    assert got == kept
    assert list(itertools.islice(got, 1)) == kept[:1]
