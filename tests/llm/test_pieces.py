"""SentencePiece by distinct marked words against the library on whole texts."""

import hashlib
import random

import pytest

from lineseek.llm import pieces
from tests.llm.conftest import text_of

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_parts_equal_the_library_on_odd_texts(library, monkeypatch):
    rnd = random.Random(5)
    signs = ["a", "b", " ", "  ", "   ", "\n", "\t", "é", "中", "▁", "the", "<s>", "</s>", "<unk>", "<0x0A>", "😀", "\x00", "\x1c", " ", "　", "1", "23", "!", "Σ", "z̈", "\r\n", "ing"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(16))) for _ in range(4000)] + ["", " ", "x" * 5000, " " * 100, "中" * 700]
    table = pieces.PartTable(MODEL)
    for large in (pieces.LARGE, 3):
        monkeypatch.setattr(pieces, "LARGE", large)
        number = pieces.Numbers()
        codes = [pieces.cut(t, number) for t in texts]
        counts, ids, back = (c.to_pylist() for c in pieces._full(table, codes, list(number)))
        for k, text in enumerate(texts):
            want = library.encode(text)
            assert (counts[k], ids[k], back[k]) == (len(want), want, library.decode(want)), repr(text)


def test_pieces_over_tables(documents, odd, none, library, monkeypatch):
    texts = text_of(documents)
    for stretch in (pieces.STRETCH, 2000):
        monkeypatch.setattr(pieces, "STRETCH", stretch)
        rows = pieces.digests(documents, MODEL).collect()
        assert len(rows) == documents.count()
        for r in rows:
            if r.doc_id is None:
                continue
            ids = library.encode(texts[r.doc_id])
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    full = {r.doc_id: r for r in pieces.encode(odd, MODEL).collect()}
    assert full[900001].ids == [] and full[900001].decoded == "" and full[900004].decoded == "a" and full[900009].ids == library.encode("ab " * 30_000)
    assert pieces.digests(none, MODEL).count() == 0 and pieces.encode(none, MODEL).count() == 0


def test_a_model_whose_pieces_cross_words_is_refused(tmp_path):
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb2.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.pieces[300].piece = "a▁b"
    path = tmp_path / "crossing.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="cross"):
        pieces.PartTable(str(path))
