"""Token containers: damage, and the work that ids and texts cost."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pytest

from equiloom.llm import common as C
from equiloom.llm import mixing_coder, piece_encoder
from equiloom.llm import token_files as T


@pytest.fixture(scope="module")
def packed():
    rng = np.random.default_rng(6)
    counts = rng.integers(1, 40, 60)
    ids = rng.zipf(1.4, int(counts.sum())).clip(0, 50000).astype(np.uint16)
    given = (np.arange(60), 2, counts, ids)
    return given, T.pack(*given)


def test_round_trip(packed):
    (keys, nulls, counts, ids), data = packed
    got = T.unpack(data)
    assert (got[0] == keys).all()
    assert got[1] == nulls
    assert (got[2] == counts).all()
    assert (got[3] == ids).all()
    empty = T.pack(keys[:0], 0, counts[:0], ids[:0])
    assert [len(x) for x in (T.unpack(empty)[0], T.unpack(empty)[3])] == [0, 0]


def test_every_bit(packed):
    """Of header and tables, and of the codes."""
    _, data = packed
    head = 8 + struct.calcsize(T._HEAD) + sum(struct.unpack_from(T._HEAD, data, 8)[5:])
    at = [*range(8 * head), *range(8 * head, 8 * len(data), 7)]
    for bit in at:
        bad = bytearray(data)
        bad[bit >> 3] ^= 1 << (bit & 7)
        with pytest.raises(ValueError, match="."):
            T.unpack(bytes(bad))


def test_cut_and_prolonged(packed):
    _, data = packed
    for n in (0, 3, 8, 40, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError, match="."):
            T.unpack(data[:n])
    with pytest.raises(ValueError, match="."):
        T.unpack(data + b"\0")


def test_blocks_learn_together():
    """many short blocks move at once, and each learns from all."""
    rng = np.random.default_rng(1)
    after = rng.permutation(3000)
    ids = np.empty((1 << 13, 32), np.int64)
    ids[:, 0] = rng.integers(0, 3000, len(ids))
    for i in range(1, 32):
        ids[:, i] = after[ids[:, i - 1]]
    ids = ids.astype(np.uint16).ravel()
    steps, predict = [], mixing_coder._Model.predict
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mixing_coder._Model, "predict", lambda self: (steps.append(1), predict(self))[1])
        data = T.pack(np.arange(1), 0, np.array([len(ids)]), ids)
    assert len(steps) <= 64
    assert 8 * len(data) / len(ids) < 0.6 * np.log2(3000)
    assert (T.unpack(data)[3] == ids).all()


@pytest.mark.parametrize("rare", [0, 0.001, 0.05])
def test_trusted_guesses(rare):
    """Ids that nearly always follow, and those that do not: the widths at both
    ends, and carries through many words."""
    rng = np.random.default_rng(3)
    ids = np.tile(np.arange(8192) % 7, (300, 1)).astype(np.uint16)[:, :500]
    wrong = rng.random(ids.shape) < rare
    ids[wrong] = rng.integers(0, 65536, wrong.sum())
    known, share = mixing_coder.prior(ids.ravel())
    codes = mixing_coder.encode(ids, known, share)
    assert (mixing_coder.decode(codes, 500, known, share) == ids).all()


def test_no_empty_interval():
    """However far the guesses are trusted, every id keeps a share."""
    known, share = mixing_coder.prior(np.arange(65536))
    for two in (mixing_coder._LEAST, mixing_coder._MOST):
        for one in (mixing_coder._LEAST, mixing_coder._MOST):
            model = mixing_coder._Model(1, known, share)
            model.slots[:65536] |= 5
            model.held[:8], model.held[8:] = two, one
            model.predict()
            parts = []
            for now in (0, 5, 1, 65535):
                ids = np.array([now])
                start, width = model.interval(ids, *(model.id != ids).astype(np.int64))
                parts.append((int(start[0]), int(start[0] + width[0])))
                for value in (parts[-1][0], parts[-1][1] - 1):
                    assert model.find(np.array([value]))[0] == ids
            parts.sort()
            assert all(a < z for a, z in parts) and all(z <= b for (_, z), (b, _) in zip(parts, parts[1:], strict=False))
            assert parts[-1][1] <= 1 << 30


def test_words_go_together():
    """words with two-byte letters are units by themselves, and new words,
    those at the start of a line too, are encoded some thousands a string."""
    import public_tokenizers

    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abdeéèñößяж"), 9))
    texts = [" ".join(word() for _ in range(4)) + "\n" + word() + "." for _ in range(1500)] + ["ends\n\n", "next \n\n line\t\tx", "é × é÷é"]
    encoder = piece_encoder.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    library, strings = encoder.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **named):
            strings.extend(texts)
            return library.encode_batch_fast(texts, **named)

    encoder.tokenizer = Counted()
    ids, n = encoder(*C.utf8(pa.array(texts)), 2)
    want = [[*e.ids, 2] for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert list(n) == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert len(strings) < 30
