import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from swatch.llm.pieces import CharMap, PieceModel, encode_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        return PieceModel(f.read()), sentencepiece.SentencePieceProcessor(model_file=PATH)


HARD = ["", " ", "  a  b ", "a\nb\t c", "▁", "a▁ b", "<s> </s> <0x41>", "x" * 3000, "é" * 200, "日本語 テスト", "\U0001F600\x00", "a" + " " * 60 + "b"]


@pytest.mark.parametrize("text", HARD)
def test_equals_library(both, text):
    own, library = both
    ids, begins, ends = own.encode(text)
    assert ids.tolist() == library.encode(text)
    assert own.decode(ids) == library.decode(ids.tolist())
    # The pieces tile the bytes of the text.
    data = text.encode()
    assert b"".join(data[a:b] for a, b in zip(begins, ends)) == data


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_equals_library_on_any_text(both, text):
    own, library = both
    ids = own.encode(text, spans=False)
    assert ids.tolist() == library.encode(text) and own.decode(ids) == library.decode(ids.tolist())


def test_decode_of_broken_bytes(both):
    own, library = both
    for ids in ([own.byte_ids[0xE2], own.byte_ids[0x82]], [own.byte_ids[0xC3], 264], [2, 264, 2]):
        assert own.decode(ids) == library.decode(ids)


def test_charmap_longest_prefix():
    # A trie by hand: "a" -> "x", "ab" -> "y".
    assert CharMap(b"").longest(b"abc", 0) is None


def test_documents(spark, odd, none):
    out = {r.doc_id: r for r in encode_documents(odd, PATH).collect()}
    assert out[1].ids == [2] and out[1].decoded == "" and out[2].ids == [2]
    assert out[8].decoded == "naïve café   \U0001F600 x"
    assert out[7].ends[-1] == 100_000
    assert encode_documents(odd, PATH).count() == 10 and encode_documents(none, PATH).count() == 0
