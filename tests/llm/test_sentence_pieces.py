"""Best paths against plain tables of scores, long words and texts, bounded memory."""

import random
import time

import numpy as np
import pytest

from chronotext.llm import sentence_pieces
from chronotext.llm.sentence_pieces import BYTE, MARK, NORMAL, UNKNOWN, Encoder, Model

_dice = random.Random(4)
_WORDS = {"".join(_dice.choice("abcé") for _ in range(_dice.randint(1, 5))) for _ in range(60)} - {"c", "é"}
SMALL = [("<unk>", 0.0, UNKNOWN), *[(f"<0x{i:02X}>", 0.0, BYTE) for i in range(256)], (MARK, -2.5, NORMAL), *[((MARK if i % 3 == 0 else "") + w, -_dice.random() * 9, NORMAL) for i, w in enumerate(sorted(_WORDS))]]


@pytest.fixture(scope="module")
def model():
    return Model(SMALL)


def worth(model, ids):
    """The path's score: bytes of a character count once, as the unknown character."""
    total, first_bytes = 0.0, {i for c, i in model.bytes.items() if c < 0x80 or c >= 0xC0}
    for i in ids:
        total += model.unknown_score * (i in first_bytes) if i in model.bytes.values() else model.scores[i]
    return total


def plain(model, text):
    """The greatest score over all ways to cut a text, by places of characters."""
    own = {p: s for p, s, kind in SMALL if kind == NORMAL}
    best = [0.0] + [-1e18] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + 7) + 1):
            if text[i:j] in own:
                best[j] = max(best[j], best[i] + own[text[i:j]])
        if text[i] not in own:
            best[i + 1] = max(best[i + 1], best[i] + model.unknown_score)
    return best[-1]


def test_best_paths(model):
    dice = random.Random(7)
    texts = ["".join(dice.choice("aabbcé漢" + MARK) for _ in range(dice.randint(1, 40))) for _ in range(400)]
    for text, ids in zip(texts, model.viterbi([t.encode() for t in texts])):
        assert worth(model, ids) == pytest.approx(plain(model, text), abs=1e-9), text


def test_long_words_take_the_same_path(model, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "STRETCH", 8)
    dice = random.Random(8)
    words = ["".join(dice.choice("aabbcé漢") for _ in range(dice.randint(1, 120))).encode() for _ in range(300)]
    assert [model._long(w) for w in words] == model._viterbi(words)
    monkeypatch.setattr(sentence_pieces, "LONG_WORD", 0)
    assert model.viterbi(words) == model._viterbi(words)


def test_word_of_a_megabyte():
    own = Model(sentence_pieces.read_pieces(sentence_pieces.model_path()))
    dice = random.Random(9)
    word = "".join(dice.choice("abcdefghijklmnop/+ABCDEF0123456789") for _ in range(1 << 20))
    began = time.time()
    (ids,) = Encoder(own).encode([word])
    assert time.time() - began < 20
    assert own.decode_all(ids.astype(np.int64), np.array([len(ids)])) == [word]


def test_memory_of_a_text_of_distinct_words(model, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 20_000)
    monkeypatch.setattr(sentence_pieces, "AT_ONCE", 100)
    encoder = Encoder(model)
    dice = random.Random(10)
    texts = [" ".join("".join(dice.choice("abc") for _ in range(9)) for _ in range(5000)), "a  b", "", "a b", f"{MARK}x " * 300]
    held = []
    bounded = encoder._bounded
    monkeypatch.setattr(encoder, "_bounded", lambda: (held.append(encoder.spaced.held + encoder.odd.held), bounded()))
    got = encoder.encode(texts)
    assert max(held) < 20_000 + 100 * 200
    assert all((a == b).all() for a, b in zip(got, [Encoder(model).encode([t])[0] for t in texts]))


def test_cpu_of_distinct_words():
    """In units of a fixed load: about 1; with every piece in the trie and words one by one 3.7 at least."""
    own = Model(sentence_pieces.read_pieces(sentence_pieces.model_path()))
    dice = random.Random(11)
    texts = [" ".join("".join(dice.choice("abcdefghilmnoprstuäé.,") for _ in range(dice.randint(3, 14))) for _ in range(40_000)) for _ in range(3)]
    loads, took = [], []
    for text in texts:
        began = time.process_time()
        sum(i * i % 7 for i in range(1_000_000))
        loads.append(time.process_time() - began)
        began = time.process_time()
        (ids,) = Encoder(own).encode([text])
        took.append(time.process_time() - began)
        assert own.decode_all(ids.astype(np.int64), np.array([len(ids)])) == [text]
    assert min(took) < 2 * min(loads)


def test_pieces_on_no_best_path_are_left_out(monkeypatch):
    dice = random.Random(12)
    fewer = 0
    for case in range(60):
        letters = "".join(dice.choice("abcé") for _ in range(200))
        names = sorted({letters[i : i + dice.randint(1, 6)] for i in range(0, 190, dice.randint(2, 20))} - {"c"})
        pieces = [*SMALL[:257], *[(w, -float(dice.randint(0, 6)) if case % 2 else -dice.random() * 9, NORMAL) for w in names]]
        words = ["".join(dice.choice("abcé漢") for _ in range(dice.randint(1, 30))).encode() for _ in range(60)]
        with monkeypatch.context() as m:
            m.setattr(sentence_pieces, "useful", lambda own: own)
            whole = Model(pieces)
        fit = Model(pieces)
        fewer += (fit.trie.piece >= 0).sum() < (whole.trie.piece >= 0).sum()
        assert fit.viterbi(words) == whole.viterbi(words) == [whole._long(w) for w in words] == [fit._long(w) for w in words]
    assert fewer > 20


def test_words_of_all_lengths_in_order(model, monkeypatch):
    """Groups of few cells, long words between short ones, empty ones, bytes of four."""
    dice = random.Random(13)
    words = ["".join(dice.choice("aabbcé漢😀\0") for _ in range(dice.choice((0, 1, 3, 9, 40, 150)))).encode() for _ in range(200)]
    alone = [model.viterbi([w])[0] for w in words]
    assert alone == [model._long(w) for w in words]
    monkeypatch.setattr(sentence_pieces, "CELLS", 100)
    assert model.viterbi(words) == alone
    assert model.viterbi([]) == []
