"""Learned profiles and answers of language identification against a plain version, and words with marks."""

import collections
import unicodedata
import zlib

from pyspark.sql import functions as F

from newsloom.llm import language
from newsloom.llm.common import table


def plain_grams(text):
    """n-grams as strings, counted letter by letter."""
    counts, word = collections.Counter(), ""
    for c in [*(text or "").lower(), " "]:
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            word += c
        elif c.isnumeric() and not c.isdecimal():
            continue
        elif word:
            if any(map(str.isalpha, word)):
                edged = f" {word} "
                counts.update(word)
                for n in (2, 3):
                    counts.update(edged[i:i + n] for i in range(len(edged) - n + 1))
            word = ""
    return counts


def packed(gram):
    number = 0
    for c in gram:
        number = (number << 21) | ord(c)
    return number


def ranked(counts, most):
    return sorted(counts, key=lambda g: (-counts[g], packed(g)))[:most]


def test_profiles_and_answers_against_a_plain_version(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([
        (9001, "नमस्ते दुनिया, नमस्ते", "hi"), (9002, "café déjà vu", "fr2"), (9004, "́ ½ 12", None),
        (9008, None, "hi"), (9009, "x² ³ y½z é²a", "fr2")], docs.schema))
    rows = docs.collect()
    sums = collections.defaultdict(collections.Counter)
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            sums[r.lang].update(plain_grams(r.text))
    profiles = {lang: ranked(c, language.PROFILE) for lang, c in sums.items() if c}
    learn = language.remainder("doc_id", 4) != 2
    learned = collections.defaultdict(dict)
    for r in language.profiles(docs.filter(learn), "text", "lang").collect():
        learned[r.lang][r.place] = r.gram
    assert {lang: [g for _, g in sorted(p.items())] for lang, p in learned.items()} == {
        lang: [packed(g) for g in p] for lang, p in profiles.items()}
    places = {lang: {g: i for i, g in enumerate(p)} for lang, p in profiles.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, learn).collect()}
    assert len(got) == len(rows)
    for r in rows:
        own = ranked(plain_grams(r.text), language.OWN)
        if not own:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        distance = {lang: sum(abs(p[g] - i) if g in p else language.PROFILE for i, g in enumerate(own))
                    for lang, p in places.items()}
        best = min(distance, key=lambda lang: (distance[lang], lang))
        assert got[r.doc_id][0] == best
        assert abs(got[r.doc_id][1] - (1 - distance[best] / (language.PROFILE * len(own)))) < 1e-12


def test_marks_belong_to_their_words(spark):
    assert language.words("नमस्ते दुनिया") == ["नमस्ते", "दुनिया"]
    assert language.words("Cafés déjà") == ["cafés", "déjà"]
    assert not len(language.grams("́"))
    found = spark.createDataFrame([(1, "́̀ 12")], "doc_id long, text string").withColumn("lang", F.lit("xx"))
    assert language.identify(found, F.lit(True)).first().lang_pred == "und"


def test_a_worker_cuts_each_word_into_grams_once_and_forgets_without_a_difference(monkeypatch):
    texts = ["ab cd ab", "x² ³ y½z é²a नमस्ते", "", "12 ́", "cd ab Straße İx ªº \ud800a", "don’t naïve 中文"] * 3
    rows = [(lang, int(g), i + 1) for lang, text in (("a", texts[0]), ("b", texts[1]))
            for i, g in enumerate(language.counted(collections.Counter(language.words(text)))[0])]
    for text in texts:
        assert language.words(text) == (language._LETTERS_AND_MARKS if language._MARKED.search(
            text.lower()) else language._LETTERS).findall(text.lower())
        got = {packed(g): n for g, n in plain_grams(text).items()}
        distinct, times = language.counted(collections.Counter(language.words(text)))
        assert dict(zip(distinct.tolist(), times.tolist(), strict=True)) == got
    cut, grams_of = [], language.grams_of
    monkeypatch.setattr(language, "grams_of", lambda new: cut.extend(new) or grams_of(new))
    whole = language.Judge(rows).judge(texts)
    assert len(cut) == len(set(cut))
    forgetful = language.Judge(rows, 1)
    monkeypatch.setattr(language, "DENSE", 0)
    assert [forgetful.judge([t])[0] for t in texts] == whole
