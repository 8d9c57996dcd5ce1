"""Token counts against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from vesselwatch.llm import counting
from vesselwatch.llm.counting import TokenCounter, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["'", "'s", "'r", "'re", "'v", "'ve", "'l", "'ll", "l", "e", "r", " ", "  ", "\n", "a", "th", "the", "THE", "aaa", "é", "É", "日本", "🙂", "\x00", "ing", ".", "!!", "0", "12"]
PARTS += ["Σ", "ΑΣ", "İ", "́", "ß", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "\xa0", "½", "-", "_", "hello", "internationalization"]


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_counts_equal_the_library(counter, library):
    texts = [*_texts(1, 3000), "", "'", "'r", "'l", "'re", "a" * 5000, "ab" * 3000, "'" * 1000, "x'" * 400]
    assert counter(texts).tolist() == library(texts)


def test_every_code_point(counter, library):
    texts = [f"a{chr(c)}b'{chr(c)}1" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert counter(texts).tolist() == library(texts)


def test_chunks_and_spans_are_no_borders(counter, library, monkeypatch):
    texts = _texts(2, 60)
    long = ["".join(texts), " ".join(texts), "'re" * 700, "é" * 3000]
    want = library(long)
    assert counter(long).tolist() == want
    monkeypatch.setattr(counting, "SPAN", 50)
    monkeypatch.setattr(counting, "LONG_WORD", 20)
    monkeypatch.setattr(counting, "LANES", 7)
    assert counter(long).tolist() == want


def test_a_full_table_begins_anew(library, monkeypatch):
    monkeypatch.setattr(counting, "TRANSITIONS", 60)
    monkeypatch.setattr(counting, "LANES", 25)
    texts = [*_texts(3, 300), "the quick brown fox jumps over lazy dogs " * 20]
    assert TokenCounter(open(PATH, "rb").read())(texts).tolist() == library(texts)


def test_splitter_states_from_any_entry():
    """Marks of a text equal those of a walk character by character."""
    splitter, (into, marks) = counting.Splitter(), counting._compile_splitter()
    kinds = np.append(np.random.default_rng(4).integers(0, 9, 5000), 0).astype(np.uint8)
    state, want = 0, np.zeros(len(kinds) + 1, bool)
    for k, c in enumerate(kinds):
        want[k] |= bool(marks[c, state] & 1)
        want[k - 1] |= bool(marks[c, state] & 2)
        state = into[c, state]
    assert (splitter.starts(kinds) == want[:-1]).all()


@pytest.mark.parametrize("letters", ["a", "abcdefghijklmnopqrstuvwxyz", "ABab01+/"])
def test_long_unbroken_texts(counter, library, letters):
    rng = random.Random(5)
    text = "".join(rng.choice(letters) for _ in range(60_000))
    assert counter([text]).tolist() == library([text])


def test_defined_cases(spark, library):
    rows = [(1, None, 5), (2, "", 6), (None, "a b", 7), (1, "x " * 3000, 8), (3, "né", None), (3, "né", None)]
    out = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH, 2048).collect()
    assert [r["n_tokens"] for r in out] == library([t or "" for _, t, _ in rows])
    assert [r["n_bytes"] for r in out] == [len((t or "").encode()) for _, t, _ in rows]
    assert [r["over_limit"] for r in out] == [False, False, False, True, False, False]
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH, 2048).count() == 0
