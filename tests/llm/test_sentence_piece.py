import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from tableloom.llm import sentence_piece
from tableloom.llm.registry import MODEL_PATH
from tests.conftest import SF
from tests.llm.tables import documents


def built(kind, byte_fallback, pieces):
    """A small model written out by hand; nothing is trained."""
    model = proto.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = kind, byte_fallback
    model.normalizer_spec.name, model.normalizer_spec.remove_extra_whitespaces = "identity", False
    for text, type_ in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        model.pieces.add(piece=text, type=type_)
    if byte_fallback:
        for b in range(256):
            model.pieces.add(piece=f"<0x{b:02X}>", type=6)
    for text, score in pieces:
        model.pieces.add(piece=text, score=score)
    return model.SerializeToString()


PIECES = [("▁", -2.0), ("a", -2.5), ("b", -2.7), ("c", -3.1), ("ab", -1.9), ("abc", -4.9), ("▁a", -2.2), ("bc", -3.3), ("ca", -3.35), ("▁ab", -5.5)]
MERGES = [("▁", -9.0), ("a", -10.0), ("b", -11.0), ("c", -12.0), ("ab", -1.0), ("▁a", -2.0), ("bc", -3.0), ("aa", -4.0), ("abc", -0.5), ("ca", -5.0), ("aab", -6.0), ("▁ab", -0.2)]


def texts(alphabet, n, seed=1):
    drawn = random.Random(seed)
    return ["".join(drawn.choices(alphabet, k=drawn.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return sentence_piece.read_model(MODEL_PATH)


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("kind, pieces", [(sentence_piece.UNIGRAM, PIECES), (sentence_piece.BPE, MERGES)])
def test_small_models_agree_with_the_library(kind, pieces, fallback):
    raw = built(kind, fallback, pieces)
    ours, library = sentence_piece.PieceTransducer(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for text in [*texts("abc ", 1500), *texts("abc é\n", 700, 2)]:
        assert ours.encode(text) == library.encode(text), text
        assert ours.decode(ours.encode(text)) == library.decode(library.encode(text))


def test_public_model_agrees_with_the_library(model):
    ours, library = sentence_piece.PieceTransducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in [*texts("abcdeABC  ▁\n\t日é☃🤖0123.,", 3000), "a" * 5000, " " * 100 + "x", "aB" * 3000, "\x00", "x▁y"]:
        assert ours.encode(text) == library.encode(text), text
        assert ours.decode(ours.encode(text)) == library.decode(library.encode(text))


def test_documents_round_trip(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    coded = sentence_piece.encode(docs, model)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    want = {r.doc_id: r.text for r in docs.collect()}
    for r in coded.collect():
        assert r.round_trip and r.ids == library.encode(want[r.doc_id]) and r.n_tokens == len(r.ids)
    assert {r.doc_id: r.text for r in sentence_piece.decode(coded, model).collect()} == want


def test_special_rows(spark, model):
    rows = [(1, None), (2, ""), (3, " "), (3, " "), (None, "x"), (4, "▁"), (5, "word " * 100_000), (6, "q" * 100_000)]
    found = sentence_piece.encode(documents(spark, rows), model)
    got = {r.doc_id: r for r in found.collect()}
    assert got[1].ids == got[2].ids == [] and got[3].n_tokens == 1 and not got[4].round_trip
    assert got[5].round_trip and got[5].n_tokens >= 100_000 and got[6].round_trip and found.count() == len(rows)
    assert sentence_piece.encode(documents(spark, []), model).collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [r.text for r in sentence_piece.decode(none, model).collect()] == [None]


def test_refused_models():
    squeezed = proto.ModelProto.FromString(built(sentence_piece.UNIGRAM, False, PIECES))
    squeezed.normalizer_spec.precompiled_charsmap = b"map"
    with pytest.raises(ValueError, match="identity"):
        sentence_piece.PieceTransducer(squeezed.SerializeToString())
