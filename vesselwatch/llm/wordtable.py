"""Token ids of texts by way of a table of their words.

A tokenizer whose merges never cross certain boundaries gives a text's ids as those of its words, one after
another. Each distinct word is encoded once for a worker (the table is emptied when it is full).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np

#: Words and characters of them that a table holds at most, before the texts at hand.
LIMIT, CHARACTERS = 300_000, 8_000_000


class _Index(dict):
    def __init__(self) -> None:
        self.fresh: list[str] = []
        self.characters = 0

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        self.fresh.append(word)
        self.characters += len(word)
        return value


class WordTable:
    """``split``: finds the words of a text; ``encode``: words -> (all ids, ids of each word)."""

    def __init__(self, split: re.Pattern, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: type = np.int32):
        self.split, self.encode, self.dtype = split.findall, encode, dtype
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.flat, self.starts, self.sizes = np.empty(0, self.dtype), np.empty(0, np.int64), np.empty(0, np.int64)

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of the texts in them); len(offsets) = len(texts) + 1."""
        if len(self.index) > LIMIT or self.index.characters > CHARACTERS:
            self._clear()
        look, codes, counts = self.index.__getitem__, [], [0]
        for text in texts:
            codes += map(look, self.split(text))
            counts.append(len(codes))
        if self.index.fresh:
            flat, sizes = self.encode(self.index.fresh)
            self.index.fresh = []
            ends = len(self.flat) + np.cumsum(sizes)
            self.starts, self.sizes = np.concatenate([self.starts, ends - sizes]), np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat.astype(self.dtype, copy=False)])
        codes = np.array(codes, np.int64)
        sizes = self.sizes[codes]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        where = np.arange(ends[-1]) + np.repeat(self.starts[codes] - ends[:-1], sizes)
        return self.flat[where], ends[counts]
