"""What the pipeline's language stage learns from."""

import zlib

import corpus_pipeline


def test_learns_from_every_labelled_row(spark, small):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "kala vene meri ranta saari", "fi", "s", 0) for i in held] + [(None, "zwölf boxkämpfer jagen viktor", "de", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.identify_language(spark, docs, small)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str)
