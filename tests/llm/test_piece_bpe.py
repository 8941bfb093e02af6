"""SentencePiece segmentation against the model's own library."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from newsloom.llm import piece_bpe
from newsloom.llm.common import table

PATH = P.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "  two  blanks ", "▁a b", "a\x00b", "<s> </s> <unk> <0x41>", "日本語 𝔘  x", "\n\n\t x\r\n", " " * 37,
       "▁" * 21 + "the", "a" * 5000, "the" * 4000, "é ​", "x" + "\U0001f600" * 70]


def strings(count):
    rng = random.Random(5)
    return ["".join(rng.choice("  ▁▁aehtns\n\tßé日𝔘.0") for _ in range(rng.randrange(160))) for _ in range(count)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, ids string, doc_id long, decoded int")


def encoded(spark, texts):
    """Clashing extra columns, repeated and missing identifiers."""
    rows = [(t, "x", None if i % 5 == 0 else i // 2, 1) for i, t in enumerate(texts)]
    return sorted(map(tuple, piece_bpe.encode(frame(spark, rows), PATH, decode=True).collect()), key=repr)


def wanted(texts):
    ids = [LIBRARY.encode(t or "") for t in texts]
    return sorted(((None if i % 5 == 0 else i // 2, n, LIBRARY.decode(n)) for i, n in enumerate(ids)), key=repr)


def test_ids_and_text_are_those_of_the_library(spark):
    texts = [*ODD, None, *strings(1500)]
    assert encoded(spark, texts) == wanted(texts)


def test_given_documents(spark, small):
    got = piece_bpe.encode(table(spark, small, "documents"), PATH, decode=True).collect()
    texts = {r.doc_id: r.text or "" for r in table(spark, small, "documents").collect()}
    assert len(got) == len(texts)
    assert all(r.ids == LIBRARY.encode(texts[r.doc_id]) and r.decoded == LIBRARY.decode(r.ids) for r in got)


def test_a_forgetful_worker_and_the_heap_find_the_same():
    texts = [*ODD, *strings(200)]
    segmenter = piece_bpe.Segmenter(PATH)
    for words in map(segmenter.model.words, texts):
        flat, lengths = segmenter.model.symbols(words)
        by_heap = [i for part in np.split(flat, np.cumsum(lengths)[:-1]) if len(part)
                   for i in piece_bpe._merge_by_heap(part.tolist(), segmenter.model.pairs)]
        assert by_heap == segmenter.model.segment(words)[0].tolist()


def test_words_are_segmented_once():
    segmenter = piece_bpe.Segmenter(PATH)
    asked = []
    own = segmenter.model.segment
    segmenter.model.segment = lambda words: asked.extend(words) or own(words)
    segmenter.encode(["the cat the cat", "the dog"])
    segmenter.encode(["dog the cat"])
    assert sorted(asked) == ["▁cat", "▁dog", "▁the"]


def test_any_ids_are_decoded_as_by_the_library(spark):
    rng = random.Random(2)
    lists = [[rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 259, 28705])
              for _ in range(rng.randrange(7))] for _ in range(3000)]
    rows = spark.createDataFrame([(i, ids) for i, ids in enumerate(lists)] + [(-1, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in piece_bpe.decode(rows, PATH).collect()}
    assert got == {-1: "", **{i: LIBRARY.decode(ids) for i, ids in enumerate(lists)}}


def test_empty_table(spark):
    found = piece_bpe.encode(frame(spark, []), PATH)
    assert found.columns == ["doc_id", "ids"] and found.count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as model_file

    spec = model_file.ModelProto()
    with open(PATH, "rb") as file:
        spec.ParseFromString(file.read())
    spec.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="plain blanks"):
        piece_bpe.PieceModel(str(tmp_path / "other.model"))
