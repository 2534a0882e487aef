import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alphaframe.llm.piece_codec import PieceCodec, encode_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CODEC = PieceCodec(MODEL)
CASES = ["", " ", "  ", " a", "a ", "a  b", "▁", "a▁ b", "▁▁a   b", "\n", "a\n b", "é" * 50, "x" * 3000, " " * 700 + "the",
         "<s> </s> <0x41>", "日本語 😀 \u0000", "the, then; there's", "\t tab", "aaaaaaaaaa" * 40, "1234567890" * 20]


def library(text):
    return CODEC.lib.encode(text, add_eos=True)


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert CODEC.encode(text) == library(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aehinorst  ▁,.éßñ日'\n0", max_size=60))
def test_random_texts(text):
    assert CODEC.encode(text) == library(text)


def test_all_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in rows.collect()}
    for r in encode_pieces(rows, MODEL).collect():
        assert r.ids == library(texts[r.doc_id])
        assert r.decoded == CODEC.lib.decode(r.ids)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a b", 6)], "doc_id long, text string, ids int")
    got = sorted([tuple(r) for r in encode_pieces(df, MODEL).collect()], key=str)
    assert got == sorted([(1, [2], ""), (1, [2], ""), (None, library("a b"), "a b")], key=str)
    assert encode_pieces(df.limit(0), MODEL).count() == 0
