"""Annotation: requests out, replies in, and a status for every article.

The model itself is outside: its replies arrive as a table with one row per attempt, or a scorer
supplied by the caller runs in ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.binding import let, settled
from newsloom.functions.jsontext import member_kind, parse_one, value_kind
from newsloom.functions.text import strip
from newsloom.operators.quality import passes_gate
from newsloom.profiles import Profile
from newsloom.schemas import RELEVANCE, SENTIMENTS
from newsloom.sources.landing import landed

# Annotations of articles that have no reply.
NEUTRAL = "中立"
NOT_RELEVANT = "否"
SUMMARY_NO_CONTENT = "无内容可供分析"
SUMMARY_LOW_QUALITY = "文章质量过低，跳过分析"
SUMMARY_FAILED = "LLM分析失败"
ERROR_PREFIX = "处理错误: "

# The instructions sent with a request.
SYSTEM_PROMPT = (
    "你是一位专业的半导体行业新闻分析师，为中国半导体公司的营销高管服务。"
    "请分析文章内容，并仅返回一个JSON对象，包含以下键值对："
    "'sentiment' (情绪分析，必须是以下之一：利好 / 中立 / 利弊)，"
    "'summary' (中文简要摘要，不超过80字)，"
    "'relevant' (相关性，必须是：是 或 否 - 该信息是否对中国半导体公司营销高管有用)。"
    "请确保返回格式严格为JSON，不要包含任何其他文本、分析或markdown格式。"
    "摘要必须是有意义的中文内容，不能为空或null。"
)
TEMPLATE_HEAD = """
请分析以下半导体行业新闻文章，并提供：

1. 情绪分析（请回答"利好"、"中立"或"利弊"）
2. 中文总结（100-200字）
3. 对中国半导体营销高管的相关性（请回答"是"或"否"）

文章内容：
"""
TEMPLATE_TAIL = """

请用以下JSON格式回答：
{
  "sentiment": "利好/中立/利弊",
  "summary": "中文总结内容",
  "relevant": "是/否"
}
"""

REPLY_FIELDS = "sentiment string, summary string, relevant string"
REPLY_KEYS = ("sentiment", "summary", "relevant")
# Places of rows are below this, for up to eight million partitions.
PLACES = 1 << 56


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def request_body(content: Column, model: str, profile: Profile, session_id: str | None = None) -> Column:
    """The JSON text of the request for one article."""
    if profile.strict_reply:
        prompt = F.concat(F.lit(TEMPLATE_HEAD), content, F.lit(TEMPLATE_TAIL))
        return F.to_json(F.struct(
            F.lit(model).alias("model"),
            F.array(_message("user", prompt)).alias("messages"),
            F.lit(500).alias("max_tokens"),
            F.lit(0.3).alias("temperature"),
        ))
    fields = [
        F.lit(model).alias("model"),
        F.array(_message("system", F.lit(SYSTEM_PROMPT)), _message("user", content)).alias("messages"),
        F.lit(0.2).alias("temperature"),
        F.lit(True).alias("preset"),
    ]
    if session_id:
        fields.append(F.lit(session_id).alias("session_id"))
    return F.to_json(F.struct(*fields))


# --- one reply ------------------------------------------------------------------------------

def valid_closed_sets(reply: Column) -> Column:
    """Sentiment and relevance from their sets, and a summary that says something."""
    summary = strip(reply["summary"])
    return F.coalesce(
        reply["sentiment"].isin(*SENTIMENTS)
        & reply["relevant"].isin(*RELEVANCE)
        & (summary != "")
        & (F.lower(summary) != "none"),
        F.lit(False),
    )


def has_reply_keys(text: Column) -> Column:
    """The three keys exist, whatever their values."""
    keys = F.json_object_keys(text)
    return F.coalesce(
        F.array_contains(keys, REPLY_KEYS[0])
        & F.array_contains(keys, REPLY_KEYS[1])
        & F.array_contains(keys, REPLY_KEYS[2]),
        F.lit(False),
    )


def identity_of(rows: DataFrame) -> str:
    """What replies name their article by: its number ``seq``, or ``content_hash`` where numbers do not last, as in
    scheduled runs that number every batch anew."""
    return "seq" if "seq" in rows.columns else "content_hash"


def decode_replies(responses: DataFrame, profile: Profile) -> DataFrame:
    """Classify each attempt: ``ok`` carries a reply, ``next`` lets another attempt count, ``stop``
    ends in failure, ``error`` ends in an error message."""
    return _decode_strict(responses) if profile.strict_reply else _decode_tolerant(responses)


ENVELOPE = f"choices array<string>, {REPLY_FIELDS}"


def _opened(responses: DataFrame) -> DataFrame:
    """Each body parsed once: ``_envelope`` (NULL unless one JSON object), its first choice and text."""
    rows = responses.withColumns({
        "_kind_of_body": value_kind(F.col("body")),
        "_envelope": parse_one(F.col("body"), ENVELOPE),
    })
    rows = rows.withColumn("_first", F.get("_envelope.choices", F.lit(0)))
    return rows.withColumn("_text", F.get_json_object("_first", "$.message.content"))


def _outcome(responses: DataFrame, kind: Column, reply: Column, message: Column) -> DataFrame:
    key = identity_of(responses)
    rows = settled(responses.select(
        key, "attempt", kind.alias("kind"), reply.alias("_reply"), message.alias("_message")),
        "kind", "_reply", "_message")
    return rows.select(
        key, "attempt", "kind",
        *[F.when(F.col("kind") == "ok", F.col("_reply")[k]).alias(k) for k in REPLY_KEYS],
        F.when(F.col("kind") == "error", F.col("_message")).alias("error_text"),
    )


# JSON texts of values that are found false.
FALSY = ("0", "0.0", "-0", "-0.0", "false", "[]", "{}", "null")


def _decode_tolerant(responses: DataFrame) -> DataFrame:
    """Nested or flat replies; the object is cut out of surrounding prose."""
    listed = F.col("_first").isNotNull()
    braces = let(F.regexp_extract("_text", r"(?s)\{.*\}", 0), lambda cut: F.when(cut != "", cut))
    rows = _opened(responses).withColumn("_object", F.when(listed, braces).otherwise(F.col("body")))
    rows = rows.withColumn("_reply", F.when(listed, parse_one(F.col("_object"), REPLY_FIELDS)).otherwise(
        F.struct(*[F.col(f"_envelope.{k}") for k in REPLY_KEYS])))
    reply = F.col("_reply")
    closed = reply["sentiment"].isin(*SENTIMENTS) & reply["relevant"].isin(*RELEVANCE)
    text_summary = F.coalesce(member_kind(F.col("_object"), "summary"), F.lit("STRING")).isin("STRING", "VOID")
    # A summary that is zero, false or an empty list or object counts as none at all.
    no_summary = F.coalesce(F.get_json_object("_object", "$.summary"), F.lit("")).isin(*FALSY)
    kind = (
        F.when(F.col("status").isNull() | (F.col("status") >= 400), "next")
        .when(F.coalesce(strip(F.col("body")), F.lit("")) == "", "stop")
        .when(F.col("_kind_of_body").isNull(), "stop")
        .when(listed & F.col("_text").isNull(), "stop")
        .when(F.col("_kind_of_body").isin("NUMBER", "INTEGER", "BOOLEAN", "NULL"), "stop")
        .when(~F.coalesce(closed, F.lit(False)), "next")
        .when(~text_summary & no_summary, "next")
        .when(~text_summary, "stop")
        .when(valid_closed_sets(reply), "ok")
        .otherwise("next")
    )
    return _outcome(rows, kind, reply, F.lit(None).cast("string"))


def _decode_strict(responses: DataFrame) -> DataFrame:
    """The message must itself be a JSON object with the three keys."""
    rows = _opened(responses).withColumns({
        "_message_object": F.get_json_object("_first", "$.message"),
        "_text": strip(F.col("_text")),
    })
    rows = rows.withColumns({
        "_reply": parse_one(F.col("_text"), REPLY_FIELDS),
        "_kind_of_text": value_kind(F.col("_text")),
    })

    def has_key(document: Column, key: str) -> Column:
        return F.coalesce(F.array_contains(F.json_object_keys(document), key), F.lit(False))

    # The messages of the errors a malformed envelope raises.
    message = (
        F.when(~has_key(F.col("body"), "choices"), "'choices'")
        .when(F.col("_first").isNull(), "list index out of range")
        .when(F.col("_message_object").isNull(), "'message'")
        .when(~has_key(F.col("_message_object"), "content"), "'content'")
        .when(F.col("_text").isNull(), "'NoneType' object has no attribute 'strip'")
        .when(F.col("_kind_of_text") == "NULL", "argument of type 'NoneType' is not iterable")
        .when(F.col("_kind_of_text") == "BOOLEAN", "argument of type 'bool' is not iterable")
        .when(F.col("_kind_of_text") == "INTEGER", "argument of type 'int' is not iterable")
        .when(F.col("_kind_of_text") == "NUMBER", "argument of type 'float' is not iterable")
    )
    rows = rows.withColumn("_problem", message)
    kind = (
        F.when(F.col("status").isNull() | (F.col("status") != 200), "next")
        .when(F.col("_kind_of_body").isNull(), "next")
        .when(F.col("_problem").isNotNull(), "error")
        .when(F.col("_reply").isNotNull() & has_reply_keys(F.col("_text")), "ok")
        .otherwise("stop")
    )
    return _outcome(rows, kind, F.col("_reply"), F.col("_problem"))


def fold_attempts(decoded: DataFrame, max_attempts: int) -> DataFrame:
    """One outcome per article: the first attempt that settles the matter.

    ``outcome`` is ``ok``, ``stop`` or ``error``; articles whose attempts all say ``next`` are absent. Decoded
    replies are landed; the first of each article is found as one number, the attempt above the place of the
    row, so that of an attempt given twice one counts.
    """
    final = decoded.filter((F.col("attempt") <= max_attempts) & (F.col("kind") != "next"))
    place = F.col("attempt") * F.lit(PLACES) + F.monotonically_increasing_id()
    rows = landed(final.withColumn("_place", place), "replies")
    key = identity_of(decoded)
    firsts = rows.groupBy(key).agg(F.min("_place").alias("_place")).select("_place")
    return rows.join(firsts, "_place", "left_semi").select(
        key, F.col("kind").alias("outcome"), *[F.col(k).alias(f"reply_{k}") for k in REPLY_KEYS], "error_text")


def replies(responses: DataFrame, profile: Profile, max_attempts: int | None = None) -> DataFrame:
    return fold_attempts(decode_replies(responses, profile), max_attempts or profile.max_attempts)


# --- routing --------------------------------------------------------------------------------

def attach(scored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Bring each article its outcome, if it has one; the identity is unique on both sides."""
    return scored.join(outcomes, identity_of(outcomes), "left")


def route(joined: DataFrame, profile: Profile, null_is_error: bool = False) -> DataFrame:
    """Give every scored article its annotation and ``processing_status``; never fails on a row.

    ``joined`` has the metrics, ``has_content`` and the outcome columns; the text itself is not needed,
    so it can be left behind before any shuffle. Rows that end in ``error`` lose their metrics.
    """
    has_content = F.col("has_content")
    gated = passes_gate(profile)
    status = (
        F.when(has_content.isNull() & F.lit(null_is_error), "error")
        .when(~F.coalesce(has_content, F.lit(False)), "no_content")
        .when(~gated, "low_quality")
        .when(F.col("outcome") == "ok", "success")
        .when(F.col("outcome") == "error", "error")
        .otherwise("failed")
    )
    null_content = F.lit("object of type 'NoneType' has no len()")
    problem = F.when(has_content.isNull(), null_content).otherwise(F.col("error_text"))
    result = joined.withColumn("processing_status", status)
    state = F.col("processing_status")

    def annotation(key: str, otherwise: Column) -> Column:
        return F.when(state == "success", F.col(f"reply_{key}")).otherwise(otherwise)

    summary = (
        F.when(state == "no_content", SUMMARY_NO_CONTENT)
        .when(state == "low_quality", SUMMARY_LOW_QUALITY)
        .when(state == "error", F.concat(F.lit(ERROR_PREFIX), problem))
        .otherwise(SUMMARY_FAILED)
    )
    lost = ["quality_score", "quality_factors", "content_length", "sentence_count", "tech_keyword_count"]
    return result.withColumns({
        "sentiment": annotation("sentiment", F.lit(NEUTRAL)),
        "summary": annotation("summary", summary),
        "relevant": annotation("relevant", F.lit(NOT_RELEVANT)),
        **{c: F.when(state != "error", F.col(c)) for c in lost if c in joined.columns},
    }).drop("outcome", "error_text", "has_content", *[f"reply_{k}" for k in REPLY_KEYS])


def scored(
    texts: DataFrame, scorer: Callable[[pd.Series], pd.DataFrame], profile: Profile, concurrency: int | None = None,
) -> DataFrame:
    """Outcomes by ``seq`` from a caller's scorer on ``texts`` (``seq, content``).

    The scorer gets a batch of texts and returns a frame with ``sentiment, summary, relevant`` in the
    same order, missing where it has no answer; it owns its own rate limit. Only the text travels to
    Python. ``concurrency`` limits the number of tasks that call the scorer at a time.
    """
    def score_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            wanted = texts.dropna()
            answers = scorer(wanted) if len(wanted) else pd.DataFrame(columns=list(REPLY_KEYS))
            answers = answers[list(REPLY_KEYS)].set_axis(wanted.index, axis=0)
            yield answers.reindex(texts.index).astype(object).where(lambda f: f.notna(), None)

    # The type hints decide the kind of UDF and are read at definition time.
    score_batches.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    call = F.pandas_udf(score_batches, REPLY_FIELDS).asNondeterministic()
    source = texts.repartition(concurrency, "seq") if concurrency else texts
    reply = F.col("_reply")
    complete = reply["sentiment"].isNotNull() & reply["summary"].isNotNull() & reply["relevant"].isNotNull()
    accepted = complete if profile.strict_reply else valid_closed_sets(reply)
    return source.select("seq", call("content").alias("_reply")).select(
        "seq", F.when(accepted, "ok").alias("outcome"), *[reply[k].alias(f"reply_{k}") for k in REPLY_KEYS],
        F.lit(None).cast("string").alias("error_text"))


# English names of the codes.
LABELS = {"利好": "positive", "中立": "neutral", "利弊": "negative", "是": "yes", "否": "no"}


def english_label(code: Column) -> Column:
    """English name of a code; anything else stays as it is."""
    named = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(named, code), code)
