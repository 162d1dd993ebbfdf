"""Ids and decoded texts against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from equiloom.llm import piece_model, piece_text
from equiloom.llm.queries import op13_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(spark, library, texts, **more):
    got = {r.doc_id: r for r in piece_text.tokenize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), PATH, **more).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        shown = library.decode(ids)
        assert got[i].ids == ids, text[:60]
        assert got[i].text == shown
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(shown.encode()).hexdigest()


ODD = [
    None, "", " ", "  a", "a ", " " * 17, " " * 400, "▁x", "▁", "a▁b", "a\x00b", "<s>", "</s> <unk>", "<0x41>", "ﬁ①", "　x", "\n\n a", "\r\n\t", "é́", "⁇", "�", "日本語 テキスト", "x" * 500, "a" * 49, "hello" * 300,
    "中文字符没有空格的文本" * 30, "\U0001f600\U0001f601 ok", "e" * 48, "e" * 47 + " ", "The the THE",
]


def test_odd_texts(spark, library):
    same(spark, library, ODD)


def test_random_texts(spark, library):
    draw = random.Random(5)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = ["".join(draw.choice("abcdefghi   \n\tABC.,;:!?éüß中①\U0001f600▁0123'\"-_/") for _ in range(draw.randint(0, 70))) for _ in range(1500)]
    texts += ["".join(draw.choice("etaoin  shr") for _ in range(draw.randint(0, 90))) for _ in range(1500)]
    texts += ["".join(draw.choice(pieces) for _ in range(draw.randint(1, 14))) for _ in range(3000)]
    same(spark, library, texts)


def test_long_texts_in_stretches(spark, library):
    draw = random.Random(6)
    long = "".join(draw.choice("etaoin  shr\né") for _ in range(2_300_000))
    same(spark, library, [long, "short", "ab" * 600_000, "zq" * 5000, long[:1_048_577]])


def test_stretches_cut_where_no_piece_lies(spark, library, monkeypatch):
    pieces = piece_model.model(PATH)
    draw = random.Random(7)
    monkeypatch.setattr(piece_text, "CHUNK", 7)
    for _ in range(300):
        text = "".join(draw.choice("abc  ing the\n中é") for _ in range(draw.randint(0, 90)))
        got = [i for _, ids in piece_text._batches([text], pieces) for i in ids.tolist()]
        assert got == library.encode(text)


def test_odd_rows(spark, odd, none, library):
    assert piece_text.tokenize(none, PATH).count() == 0
    got = piece_text.tokenize(odd, PATH).collect()
    want = [(r.doc_id, library.encode(r.text or "", add_bos=True, add_eos=True)) for r in odd.collect()]
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(d), i) for d, i in want)


def test_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in op13_sentencepiece(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_bos=True, add_eos=True)
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_other_models_are_refused(tmp_path):
    with open(PATH, "rb") as f:
        data = f.read()
    keeps, drops = (b"identity\x12\x00\x18\x01\x20" + x for x in (b"\x00", b"\x01"))  # repeated spaces
    assert data.count(keeps) == 1
    path = tmp_path / "other.model"
    path.write_bytes(data.replace(keeps, drops))
    with pytest.raises(ValueError, match="merge-type"):
        piece_model.PieceModel(str(path))
