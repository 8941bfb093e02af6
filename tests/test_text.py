"""Native expressions against Python's own string functions."""

import hashlib
import html
import random
from urllib.parse import urljoin, urlparse

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import dates as D
from newsloom.functions import hashing as H
from newsloom.functions import text as T
from newsloom.functions import urls as U
from newsloom.profiles import PROFILE_B
from newsloom.functions.hashing import content_hash

EDGE = ["x\xa0y", "　中 文　", "a\x1cb", "İstanbul", "ΟΔΟΣ ΣΑΣ", "ẞ straße", "\x85q\x0b r", "😀 Ab",
        "é​ x", "", " ", "\n \t", "a..b. .c.", "...", ". \xa0.x .", "no stop", "  a  b\n\n c  "]


def random_texts(count=300, seed=7):
    source = random.Random(seed)
    letters = "aB.é中 \n\t\xa0 　\x1c\x1f\x85&;#xX<>😀İΣß'\""
    return ["".join(source.choice(letters) for _ in range(source.randrange(0, 40))) for _ in range(count)]


def evaluate(spark, texts, expression):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    rows = frame.select("i", expression(F.col("s")).alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


def check(spark, texts, expression, expected):
    got = evaluate(spark, texts, expression)
    wrong = [(t, g, expected(t)) for t, g in zip(texts, got, strict=True) if g != expected(t)]
    assert not wrong, wrong[:5]


def test_white_space_is_pythons():
    assert all(chr(c).isspace() == (chr(c) in T.WHITESPACE) for c in range(0x110000))


def test_strip_collapse_sentences(spark):
    texts = EDGE + random_texts()
    check(spark, texts, T.strip, str.strip)
    check(spark, texts, T.collapse, lambda s: " ".join(s.split()))
    check(spark, texts, T.sentence_count, lambda s: len([p for p in s.split(".") if p.strip()]))


def test_hash_a(spark):
    def expected(s):
        return hashlib.md5(" ".join(s.lower().strip().split()).encode()).hexdigest()

    check(spark, EDGE + random_texts(), H.normalised_hash, expected)
    assert evaluate(spark, ["Hello   World", " hello\nworld ", " \n "], H.normalised_hash) == [
        "5eb63bbbe01eeed093cb22bb8f5acdc3", "5eb63bbbe01eeed093cb22bb8f5acdc3",
        "d41d8cd98f00b204e9800998ecf8427e"]


def test_hash_b_keeps_headline_and_spacing(spark):
    got = evaluate(spark, ["a  b", "a b"], lambda s: content_hash(F.lit("h"), s, PROFILE_B))
    assert got == [hashlib.md5(b"h|a  b").hexdigest(), hashlib.md5(b"h|a b").hexdigest()]


REFERENCES = [
    "a&amp;lt;b", "&copy 2020 &copyx &notit; &notin; &#65;&#x1F600; &#150; &#129; &#0; &#xD800; &#1; &#11;",
    "&bogus; & x &#38;amp; &#99999999999; &NotEqualTilde;", "x &amp;&amp;&amp; y&quot;", "&#xFFFE;&#x1FFFF;&#xFDD0;",
    "&eacute;&lang;&AMP;&ampfoo&#;&#x;&", "&nbsp;x&nbsp;", "&semi;&equals;&apos;&bsol;&#0000000000065;", "&#x110000;",
]


def test_character_references(spark):
    check(spark, REFERENCES + random_texts(200, 3), T.decode_entities, html.unescape)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("&#x19;ampltqocy <A"), max_size=20), min_size=1, max_size=60))
def test_character_references_property(spark, texts):
    check(spark, texts, T.decode_entities, html.unescape)


BASES = ["https://www.ti.com/x/", "http://a.b/c/d;p?q", "https://h", "https://h?q=1",
         "HTTP://u@h:80/a/b/../c?x#f", "https://h/a//b/"]
HREFS = ["", "/", "?", "#", "?y=2", "#s", "g", "./g", "g/", "/g", "//g", "g?y", "g#s", "..", "../", "../g",
         "../..", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "./g/.", "g/./h", "g/../h", "http:g",
         "http://x/y/../z", "mailto:x@y", "javascript:void(0)", "a//b", "//h2/p/../q?z", "?", "a?", "a#", "x:y",
         "https:rel", " /lead", "a\nb", "/für", "/The,", "/a//b/../c", "g;x=1/../y", "tel:123", "/%%%"]


def test_resolve_is_urljoin(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    frame = spark.createDataFrame(pairs, "b string, h string")
    rows = frame.select("b", "h", U.resolve(F.col("b"), F.col("h")).alias("u"),
                        U.netloc(F.col("h")).alias("n")).collect()
    assert not [(r.b, r.h, r.u, urljoin(r.b, r.h)) for r in rows if r.u != urljoin(r.b, r.h)]
    assert not [(r.h, r.n) for r in rows if r.n != urlparse(r.h).netloc]


def test_netloc_keeps_user_and_port(spark):
    assert evaluate(spark, ["https://u@h:80/x"], U.netloc) == ["u@h:80"]


def test_naive_resolution(spark):
    base = F.lit("https://h/x//")
    got = evaluate(spark, ["/a", "b", "http://z", ""], lambda h: U.resolve_naive(base, h))
    assert got == ["https://h/x/a", "https://h/x/b", "http://z", None]


def test_snapshot_key(spark):
    assert evaluate(spark, ["https://a.b/c/d", "http://a.b"], U.snapshot_key) == [
        "downloaded_a.b_c_d.html", "downloaded_a.b.html"]


def test_card_dates(spark):
    given_, wanted = (["07.08.2025", "07.08.25", "2025-07-08", "July 7, 2025", ""],
                      ["07.08.2025", "07.08.2025", "07.08.2025", "July 7, 2025", ""])
    assert evaluate(spark, given_, D.card_date) == wanted


def test_store_dates(spark):
    texts = ["2025-07-08", "2025/07/08", "07.08.2025", "07.08.25", "July 8, 2025", "", "soon", "2025-02-30"]
    lenient = [str(d) if d else None for d in evaluate(spark, texts, D.lenient_date)]
    assert lenient == ["2025-07-08"] * 5 + [None] * 3
    strict = [d is not None for d in evaluate(spark, texts, D.strict_date)]
    assert strict == [True] + [False] * 7
