"""Sum-of-squares online packing of token sequences.

A document's whole windows stand alone; its remainder goes to the fill level at which the sum of the
squared numbers of partially filled windows grows least. The numbers are a level array, one entry for each
fill. Each input partition packs its own documents (nothing is shuffled); its last open windows are cut
into each other, and the last rest becomes sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselwatch.llm.common import bounded_batches
from vesselwatch.llm.wordtable import WordTable

#: The pattern that splits text before the merges of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space in the sense of that pattern (Unicode White_Space).
_WHITE = "\t-\r \x85\xa0  -     　"
#: Pieces of a text that the pattern never crosses: white space runs, and the rest with one space before.
_CHUNKS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


class Vocabulary:
    """A byte-level vocabulary in a tokenizer file (JSON), whose merges are numbered in the order of its ids."""

    def __init__(self, data: bytes):
        file = json.loads(data)
        spelled = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(spelled[c] for c in token): k for token, k in file["model"]["vocab"].items() if all(c in spelled for c in token)}
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        for token in self.added:
            ranks.pop(token.encode(), None)
        merges = (m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"])
        order = [ranks[bytes(spelled[c] for c in a + b)] for a, b in merges]
        if order != sorted(order):
            raise ValueError("the ids of merged tokens don't follow the order of merges")
        encode = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def words(fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = [encode(w) for w in fresh]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((i for w in ids for i in w), np.uint32, sizes.sum()), sizes

        self.table = WordTable(_CHUNKS, words, np.uint32)
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")") if self.added else None

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of the texts in them). An added token in a text is its own id; what lies between is encoded by itself."""
        if self.cut is None or not any(t in text for text in texts for t in self.added):
            return self.table(texts)
        parts = [self.cut.split(text) for text in texts]  # ordinary text and added tokens in turn
        flat, cuts = self.table([p for text in parts for p in text[::2]])
        out, ends, k = [], [0], 0
        for text in parts:
            for at, part in enumerate(text):
                if at % 2:
                    out.append(np.array([self.added[part]], np.uint32))
                else:
                    out.append(flat[cuts[k] : cuts[k + 1]])
                    k += 1
            ends.append(ends[-1] + sum(map(len, out[len(out) - len(text) :])))
        return np.concatenate(out), np.array(ends)


def _byte_letters() -> dict[int, str]:
    """The letter for each byte in the vocabulary: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


@lru_cache(2)
def _vocabulary(data: bytes) -> Vocabulary:
    return Vocabulary(data)


class Packer:
    """Windows of ``size`` tokens. Rows: (document's place, start, ids, window, offset)."""

    def __init__(self, size: int):
        self.size = size
        self.level = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]  # by fill: windows' pieces
        self.windows = 0

    def _new(self) -> int:
        self.windows += 1
        return self.windows - 1

    def add(self, doc: int, ids: np.ndarray) -> Iterator[tuple]:
        """Rows of windows that are complete now."""
        whole = len(ids) - len(ids) % self.size
        for start in range(0, whole, self.size):
            yield doc, start, ids[start : start + self.size], self._new(), 0
        if whole < len(ids):
            yield from self._place((doc, whole, ids[whole:].copy() if whole else ids))

    def _place(self, piece: tuple) -> Iterator[tuple]:
        n = len(piece[2])
        fill = self._best(n)
        window = self.open[fill].pop() if fill else []
        self.level[fill] -= fill > 0
        window.append(piece)
        if fill + n == self.size:
            yield from self._rows(window)
        else:
            self.level[fill + n] += 1
            self.open[fill + n].append(window)

    def _best(self, n: int) -> int:
        """The fill (0: a new window) whose choice adds least to the sum of squares; ties: the fullest."""
        after = 2 * self.level[n:] + 1  # by old fill
        after[-1] = 0  # a full window counts no more
        after[1:] -= 2 * self.level[1 : self.size + 1 - n] - 1
        after[1:][self.level[1 : self.size + 1 - n] == 0] = np.iinfo(np.int64).max
        return len(after) - 1 - int(after[::-1].argmin())

    def _rows(self, window: list) -> Iterator[tuple]:
        number, offset = self._new(), 0
        for doc, start, ids in window:
            yield doc, start, ids, number, offset
            offset += len(ids)

    def finish(self) -> Iterator[tuple]:
        """Rows of all windows still open: the emptiest are cut to fill the fullest."""
        left = [w for fill in range(self.size, 0, -1) for w in self.open[fill]]
        fills = [sum(len(p[2]) for p in w) for w in left]
        low = len(left) - 1
        for k, window in enumerate(left):
            while fills[k] < self.size and low > k:
                doc, start, ids = left[low].pop()
                room = self.size - fills[k]
                if len(ids) > room:
                    left[low].append((doc, start, ids[:-room]))
                    start, ids = start + len(ids) - room, ids[-room:]
                window.append((doc, start, ids))
                fills[k] += len(ids)
                fills[low] -= len(ids)
                low -= fills[low] == 0
            if fills[k] == self.size:
                yield from self._rows(window)
            elif fills[k]:
                yield from self._powers(window, fills[k])

    def _powers(self, window: list, fill: int) -> Iterator[tuple]:
        queue = window[::-1]
        while fill:
            room = 1 << (fill.bit_length() - 1)
            fill -= room
            part = []
            while room:
                doc, start, ids = queue.pop()
                if len(ids) > room:
                    queue.append((doc, start + room, ids[room:]))
                    ids = ids[:room]
                part.append((doc, start, ids))
                room -= len(ids)
            yield from self._rows(part)


def _pack(file, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, packer = _vocabulary(file.value), Packer(size)
        base = TaskContext.get().partitionId() << 40
        open_docs: dict[int, list] = {}  # place: id, tokens, tokens not yet returned
        seen = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            ids, totals = [], []
            for doc, _, tokens, _, _ in rows:
                entry = open_docs[doc]
                ids.append(entry[0])
                totals.append(entry[1])
                entry[2] -= len(tokens)
                if not entry[2]:
                    del open_docs[doc]
            return pa.record_batch(
                [
                    pa.array(ids, pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([r[2].tobytes() for r in rows], pa.binary()),
                    pa.array(totals, pa.int64()), pa.array([base + r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
                ],
                names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                flat, cuts = table([t or "" for t in part.column(1).to_pylist()])
                rows = []
                for k, doc_id in enumerate(part.column(0).to_pylist()):
                    tokens = np.empty(cuts[k + 1] - cuts[k] + 1, "<u4")
                    tokens[:-1], tokens[-1] = flat[cuts[k] : cuts[k + 1]], end
                    open_docs[seen] = [doc_id, len(tokens), len(tokens)]
                    rows += packer.add(seen, tokens)
                    seen += 1
                yield out(rows)
        rows = []
        for row in packer.finish():
            rows.append(row)
            if len(rows) == 1024:
                yield out(rows)
                rows = []
        yield out(rows)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids (binary: little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's tokens are those of its whole text by the tokenizer file at ``tokenizer_path`` (byte-level BPE; added
    tokens in a text are their own ids) and the id ``end``. Each token lies in one piece,
    pieces fill a sequence from offset 0 without a gap, sequences hold at most ``size`` tokens. Of each input
    partition all sequences are full but for a last rest, which is cut into powers of two. Sequence ids
    hold the partition's number above bit 40.

    Defined cases: a null or empty text is one token (``end``); null and repeated ids pass through as
    documents of their own; long texts are cut at whole windows; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't follow the data
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packed = rows.mapInArrow(_pack(file, size, end), "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
