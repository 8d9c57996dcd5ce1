"""Encoding and decoding against the sentencepiece library."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from vesselwatch.llm import pieces
from vesselwatch.llm.pieces import SPACE, PieceModel, round_trip
from vesselwatch.llm.wordtable import WordTable

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return PieceModel(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _texts():
    rng = random.Random(3)
    parts = ["a", "b", "th", "the", " ", "  ", "   ", "\n", "\t", "\r", "aaa", "e", "▁", "é", "日本", "🙂", "\x00", "int ", "‍", "ing", ".", " ", "<0x0A>", "<s>", "0", "1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    return texts + ["", " ", " " * 100, "a" * 500, "ab" * 300, "the " * 200, "x \n  y", "\n\n\n"]


def test_ids_equal_the_library(model, library):
    texts = _texts()
    ids, offsets = WordTable(model.split, model.encode_words)([model.prefix + t.replace(SPACE, " ") if t else "" for t in texts])
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(text), repr(text)


@pytest.mark.parametrize("letters", ["ab", "aab ", "etaoin", "abcdefghijklmnopqrstuvwxyz", "01", "é日本🙂ab", " ", "=-", "the "])
def test_words_joined_of_parts(model, library, letters, monkeypatch):
    """Short parts, so that many borders don't fit at first; periodic texts, whose pieces follow from their beginning."""
    monkeypatch.setattr(pieces, "LONG_WORD", 6)
    monkeypatch.setattr(pieces, "PART", 5)
    rng = random.Random(letters)
    for _ in range(150):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 120)))
        if rng.random() < 0.3:
            text = text[:7] * rng.randrange(1, 30)
        assert model.encode_words([" " + text])[0].tolist() == library.encode(text), repr(text)


@pytest.mark.parametrize("letters", [" ", "a", "ab", "abcdefghijklmnopqrstuvwxyz", "ABCDabcd0123+/"])
def test_very_long_words_take_time_by_their_length(model, library, letters):
    rng = random.Random(6)
    text = "".join(rng.choice(letters) for _ in range(200_000)) if len(letters) > 2 else letters * (200_000 // len(letters))
    started = time.monotonic()
    ids = model.encode_words([" " + text])[0].tolist()
    assert time.monotonic() - started < 20
    assert ids == library.encode(text)


def test_decoding_equals_the_library(model, library):
    rng = random.Random(4)
    lists = [library.encode(t) for t in _texts()]
    lists += [[rng.choice([0, 1, 2, 3, 100, 200, 234, 240, 250, 259, 300, 28705, 30000]) for _ in range(rng.randrange(12))] for _ in range(2000)]
    flat = np.array([i for x in lists for i in x], np.int64)
    data, cuts = model.decode(flat, np.concatenate(([0], np.cumsum([len(x) for x in lists]))))
    for k, ids in enumerate(lists):
        assert data[cuts[k] : cuts[k + 1]].tobytes().decode() == library.decode(ids), ids


def test_defined_cases(spark, library):
    rows = [(1, None, 5), (2, "", 6), (None, "a b", 7), (1, "x" * 70000, 8), (3, "x  y", None)]
    out = round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH).collect()
    assert [r["ids"] for r in out] == [library.encode(t or "") for _, t, _ in rows]
    assert [r["decoded"] for r in out] == [t or "" for _, t, _ in rows]
    assert round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
