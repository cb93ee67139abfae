"""Token counts against the library on whole texts."""

import pytest
import sentencepiece

import public_tokenizers
from driftline.llm import token_counts as tc
from tests.llm.fixtures import AWKWARD, DOCS, frame, rows

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    " ", "  ", "\n", "\n\n ", " \n", "a\n b", "▁", "▁▁ ▁x", "x▁ y", "<s> </s> <unk> <pad>", "<0x0A>", "\x00\x01\t\r\x0b", "a\x00 b", "ﬁ ①½ Ａ",
    "é é", "中文 字　字", "\U0001f600 \U0001f468‍\U0001f469", "x" * 300 + " " * 40 + "y", "a\xa0b", "don't  stop", "1234567 89",
    "  lead", "trail  ", "https://" + "abc/" * 60 + " again", " line ", "﻿bom", "ا ل ع",
]


@pytest.fixture(scope="module")
def pieces():
    return tc.load(PATH)


def expected(data, limit=tc.LIMIT):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    count = lambda t: len(sp.encode(t)) if t else 0
    return sorted((str(r[0]), len((r[1] or "").encode()), count(r[1]), count(r[1]) > limit) for r in data)


def got(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


@pytest.mark.parametrize("most_common", [tc.COMMON_TOKENS, 10, 1])
def test_as_the_library(spark, pieces, most_common):
    data = rows(60) + AWKWARD + [(2000 + i, t, "en", "odd", len(t)) for i, t in enumerate(ODD)]
    assert got(tc.count_tokens(frame(spark, data), pieces, most_common=most_common)) == expected(data)


def test_every_registered_document(spark, sf, pieces):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(tc.count_tokens(docs, pieces)) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_limit_and_clashing_names(spark, pieces):
    data = rows(20)
    more = frame(spark, data).selectExpr("*", *[f"'mine' AS {c}" for c in "n_tokens n_bytes key row word words pieces held k more".split()])
    assert got(tc.count_tokens(more, pieces, limit=40)) == expected(data, 40)
    big = spark.createDataFrame([((1 << 60) + 1, "one two"), (None, "three")], "doc_id long, text string")
    assert {r["doc_id"] for r in tc.count_tokens(big, pieces).collect()} == {(1 << 60) + 1, None}


def test_no_rows(spark, pieces):
    assert tc.count_tokens(spark.createDataFrame([], DOCS), pieces).count() == 0
    assert got(tc.count_tokens(frame(spark, [(1, None, None, None, None)]), pieces)) == [("1", 0, 0, False)]


def test_each_pre_token_is_encoded_once_and_common_ones_are_few(spark, pieces):
    docs = frame(spark, rows(60))
    counts = tc.piece_counts(tc.distinct_pre_tokens(docs), pieces)
    assert counts.count() == counts.select("word").distinct().count()
    for most in (1, 7, 50):
        assert 0 <= len(tc.common_pre_tokens(counts, most)) <= most
    long = "z" * 500
    data = [(i, f"{long} w{i}", "en", "s", 0) for i in range(30)]
    held = tc.piece_counts(tc.distinct_pre_tokens(frame(spark, data)), pieces)
    assert tc.short(" " + long) in tc.common_pre_tokens(held, 10)


def test_pre_tokens_are_the_whole_text():
    for text in [*ODD, *[r[1] for r in AWKWARD if r[1]]]:
        assert "".join(tc.pre_tokens(text)) == " " + text
    assert tc.pre_tokens("") == [] == tc.pre_tokens(None)


def test_a_vocabulary_that_crosses_pre_tokens_is_refused(monkeypatch, tmp_path):
    class Crossing:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "of▁the"

    monkeypatch.setattr(tc.Pieces, "processor", lambda self: Crossing())
    file = tmp_path / "m"
    file.write_bytes(b"x")
    with pytest.raises(ValueError, match="crosses"):
        tc.load(str(file))
