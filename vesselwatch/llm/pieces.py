"""SentencePiece (BPE) encoding and decoding in vectorised merge rounds.

The distinct words of a batch lie end to end in one flat array of symbols. A round looks up the rank of
every adjacent pair, takes each word's best rank (segmented minimum), merges that pair's leftmost
non-overlapping occurrences in all words at once and compacts the array; words without a pair left leave.

Merging all occurrences at once equals merging one after another as long as no merge makes a pair of the
same or a better rank possible. Ranks for which the vocabulary holds such a pair are marked when the
model is read: of these, a round merges only the leftmost in a word.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselwatch.llm.common import bounded_batches
from vesselwatch.llm.wordtable import WordTable

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Symbols of characters that the vocabulary lacks start here (plus the code point).
LACKING = 1 << 22
NEVER = np.iinfo(np.int32).max
#: Characters from which on a word is encoded in parts, and of such a part: rounds are as many as a part's characters at most.
LONG_WORD, PART = 256, 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


class PieceModel:
    """A BPE model file: identity normaliser, spaces escaped and kept, byte fallback."""

    def __init__(self, data: bytes):
        self.pieces, scores, self.kinds = [], [], []
        dummy_prefix = True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                if trainer.get(3, 1) != 2:
                    raise ValueError("not a BPE model")
                self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
            elif number == 3:
                spec = dict(_fields(value))
                dummy_prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models that keep the text as it is are supported")
        if any(k in (USER, UNUSED) for k in self.kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = " " if dummy_prefix else ""
        self.bytes = np.full(256, -1, np.int64)
        self.unknown = -1
        vocab: dict[str, int] = {}
        for k, (piece, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if kind == BYTE:
                self.bytes[int(piece[3:5], 16)] = k
            elif kind == UNKNOWN:
                self.unknown = k
            elif kind == NORMAL:
                vocab[piece] = k
        self._merges(vocab, scores)
        self._words(vocab)
        self._surfaces()

    def _merges(self, vocab: dict[str, int], scores: list[float]) -> None:
        chars = np.arange(0x110000, dtype=np.int32) + LACKING
        for piece, k in vocab.items():
            if len(piece) == 1:
                chars[ord(piece)] = k
        chars[0x20] = chars[ord(SPACE)]
        self.chars = chars
        order = {s: r for r, s in enumerate(sorted({scores[k] for k in vocab.values()}, reverse=True))}
        keys, made, careful = [], [], set()
        for piece, k in vocab.items():
            for cut in range(1, len(piece)):
                a, b = vocab.get(piece[:cut]), vocab.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a << 24 | b)
                    made.append(k)
                    careful.update(scores[x] for x in (a, b) if scores[x] <= scores[k])
        keys = np.array(keys, np.int64)
        by_key = np.argsort(keys)
        self.keys, self.made = keys[by_key], np.array(made, np.int32)[by_key]
        self.rank = np.array([order[scores[k]] for k in self.made], np.int32)
        self.careful = np.array([s in careful for s in order], bool)  # by rank

    def _words(self, vocab: dict[str, int]) -> None:
        """Boundaries that no piece crosses: before a space after something else; around line ends."""
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in vocab):
            raise ValueError("a piece holds a space behind a character: words are not independent")
        alone = "\n" if not any("\n" in p for p in vocab if len(p) > 1) else ""
        self.split = re.compile(f"{alone}+| *[^ {alone}]+| +" if alone else " *[^ ]+| +")

    def _surfaces(self) -> None:
        texts = []
        for piece, kind in zip(self.pieces, self.kinds, strict=True):
            if kind == BYTE:
                texts.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                texts.append(b"")
            elif kind == UNKNOWN:
                texts.append(self.unknown_text.encode())
            else:
                texts.append(piece.replace(SPACE, " ").encode())
        self.surface = texts
        self.surface_size = np.array([len(t) for t in texts], np.int64)
        self.surface_start = np.concatenate(([0], np.cumsum(self.surface_size)[:-1]))
        self.surface_bytes = np.frombuffer(b"".join(texts), np.uint8)
        kinds = np.array(self.kinds)
        self.is_control, self.is_byte = kinds == CONTROL, kinds == BYTE
        self.starts_with_space = np.array([p.startswith(SPACE) and k == NORMAL for p, k in zip(self.pieces, self.kinds, strict=True)])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each word). Long words are encoded in parts that are joined."""
        long = [k for k, w in enumerate(words) if len(w) > LONG_WORD]
        if not long:
            return self._fall_back(*self._merged(words), len(words))
        short = [w if len(w) <= LONG_WORD else "" for w in words]
        sym, word = self._merged(short)
        joined = [self._joined(words[k]) for k in long]
        sym = np.concatenate([sym, *joined])
        word = np.concatenate([word, np.repeat(np.array(long, np.int32), [len(j) for j in joined])])
        order = np.argsort(word, kind="stable")
        return self._fall_back(sym[order], word[order], len(words))

    def _joined(self, text: str) -> np.ndarray:
        """Symbols of a long word in time that grows with its length.

        A sequence of symbols is the encoding of its text if each two neighbours are that of theirs: the first merge across
        a border would be the first one across it among the two alone, too, as merges elsewhere change neither what they hold nor
        which of their merges comes next. So parts are encoded by themselves, and where two of them don't fit, the symbols around the border
        are encoded anew, more of them each time.
        """
        parts = [(p, 4) for p in self._split_merged([text[k : k + PART] for k in range(0, len(text), PART)])]
        fits: dict[tuple[int, int], bool] = {}
        while True:
            borders = [(int(a[0][-1]), int(b[0][0])) for a, b in zip(parts[:-1], parts[1:], strict=True)]
            fresh = [x for x in dict.fromkeys(borders) if x not in fits]
            for pair, encoded in zip(fresh, self._split_merged([self._text(x) for x in fresh]), strict=True):
                fits[pair] = tuple(encoded.tolist()) == pair
            bad = [k for k, x in enumerate(borders) if not fits[x]]
            if not bad:
                return np.concatenate([p for p, _ in parts])
            rows, taken, free = [], [], 0
            for k in bad:
                if k < free:
                    continue  # lies in a window already
                m = max(parts[k][1], parts[k + 1][1])
                lo, left = k, len(parts[k][0])
                while left < m and lo > free:
                    lo -= 1
                    left += len(parts[lo][0])
                hi, right = k + 1, len(parts[k + 1][0])
                while right < m and hi + 1 < len(parts):
                    hi += 1
                    right += len(parts[hi][0])
                spare, rest = max(left - m, 0), max(right - m, 0)
                window = np.concatenate([p for p, _ in parts[lo : hi + 1]])
                rows += parts[free:lo]
                if spare:
                    rows.append((window[:spare], parts[lo][1]))
                rows.append((len(taken), 2 * m))
                taken.append(window[spare : len(window) - rest])
                if rest:
                    rows.append((window[len(window) - rest :], parts[hi][1]))
                free = hi + 1
            windows = self._split_merged([self._text(w) for w in taken])
            parts = [(windows[p], m) if isinstance(p, int) else (p, m) for p, m in rows + parts[free:]]

    def _text(self, symbols) -> str:
        return "".join(self.pieces[s] if s < LACKING else chr(s - LACKING) for s in map(int, symbols))

    def _split_merged(self, words: list[str]) -> list[np.ndarray]:
        sym, word = self._merged(words)
        return np.split(sym, np.cumsum(np.bincount(word, minlength=len(words)))[:-1]) if words else []

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all words, the word of each) after all merges."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.chars[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        done_sym, done_word = [], []
        while len(sym):
            inner = word[1:] == word[:-1]
            key = (sym[:-1].astype(np.int64) << 24) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(sym), NEVER, np.int32)
            rank[:-1] = np.where(inner & (self.keys[at] == key), self.rank[at], NEVER)
            starts = np.concatenate(([0], np.flatnonzero(~inner) + 1))
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            over = low == NEVER
            done_sym.append(sym[over])
            done_word.append(word[over])
            pos = np.flatnonzero((rank == low) & ~over)
            if not len(pos):
                break
            # of a run of overlapping occurrences every second one merges, from the left
            new_run = np.concatenate(([True], pos[1:] != pos[:-1] + 1))
            place = np.arange(len(pos))
            pos = pos[((place - np.maximum.accumulate(np.where(new_run, place, 0))) & 1) == 0]
            first = np.concatenate(([True], word[pos[1:]] != word[pos[:-1]]))
            pos = pos[first | ~self.careful[rank[pos]]]
            sym[pos] = self.made[at[pos]]
            keep = ~over
            keep[pos + 1] = False
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym) if done_sym else sym, np.concatenate(done_word) if done_word else word
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _fall_back(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        lacking = np.flatnonzero(sym >= LACKING)
        if len(lacking):
            spelled = [self._spell(int(s) - LACKING) for s in sym[lacking]]
            times = np.ones(len(sym), np.int64)
            times[lacking] = [len(s) for s in spelled]
            ends = np.cumsum(times)
            sym, word = np.repeat(sym, times), np.repeat(word, times)
            for at, ids in zip(ends[lacking], spelled, strict=True):
                sym[at - len(ids) : at] = ids
        return sym.astype(np.int32), np.bincount(word, minlength=n)

    def _spell(self, code: int) -> list[int]:
        ids = self.bytes[list(chr(code).encode("utf-8", "surrogatepass"))]
        return ids.tolist() if (ids >= 0).all() else [self.unknown]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes of all texts, offsets of the texts in them)."""
        sizes = self.surface_size[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        data = self.surface_bytes[np.arange(ends[-1]) + np.repeat(self.surface_start[ids] - ends[:-1], sizes)]
        cuts = ends[offsets]
        if self.prefix:  # the space that encoding put in front
            first = self._firsts(ids, offsets)
            first = first[self.starts_with_space[ids[first]]]
            keep = np.ones(len(data), bool)
            keep[ends[first]] = False
            data = data[keep]
            cuts = cuts - np.searchsorted(ends[first], cuts)
        heads = data[cuts[:-1][cuts[:-1] < cuts[1:]]]
        try:
            data.tobytes().decode()
            if ((heads & 0xC0) != 0x80).all():
                return data, cuts
        except UnicodeDecodeError:
            pass
        texts = [_repair(data[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)

    def _firsts(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the first piece of each text that isn't a control piece lies."""
        plain = np.flatnonzero(~self.is_control[ids])
        at = np.searchsorted(plain, offsets[:-1])
        ok = at < len(plain)
        first = plain[at[ok]]
        return first[first < offsets[1:][ok]]


def _repair(data: bytes) -> bytes:
    """Each byte that isn't part of valid UTF-8 becomes U+FFFD."""
    out = []
    while data:
        try:
            data.decode()
            out.append(data)
            break
        except UnicodeDecodeError as e:
            out += [data[: e.start], "�".encode()]
            data = data[e.start + 1 :]
    return b"".join(out)


@lru_cache(2)
def _model(data: bytes) -> PieceModel:
    return PieceModel(data)


@lru_cache(2)
def _table(data: bytes) -> WordTable:
    model = _model(data)
    return WordTable(model.split, model.encode_words)


def _encoder(model):
    def run(texts: pa.Array) -> pa.Array:
        table, prefix = _table(model.value), _model(model.value).prefix
        parts = []
        for at in range(0, len(texts), 512):
            ids, offsets = table([prefix + t.replace(SPACE, " ") if t else "" for t in texts[at : at + 512].to_pylist()])
            parts.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return run


def _decoder(model):
    def run(lists: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(lists), 512):
            part = lists[at : at + 512]
            sizes = np.array(pa.compute.fill_null(pa.compute.list_value_length(part), 0), np.int64)
            data, cuts = _model(model.value).decode(part.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes))))
            parts.append(pa.StringArray.from_buffers(len(part), pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run


def load_model(spark: SparkSession, path: str):
    """The model file as a broadcast value (its size is that of a vocabulary file, whatever the data)."""
    bounded_batches(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_pieces(text: Column, model) -> Column:
    """array<int>: ids of a text without begin or end ids; null and empty texts have none."""
    return F.arrow_udf(_encoder(model), "array<int>")(F.coalesce(text, F.lit("")))


def decode_pieces(ids: Column, model) -> Column:
    """The text of ids; null or no ids: the empty text; bytes that aren't UTF-8 become U+FFFD each."""
    return F.arrow_udf(_decoder(model), "string")(F.coalesce(ids, F.array().cast("array<int>")))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row.

    Defined cases: a null text is encoded as the empty one (no ids, decoded to the empty text); null and
    repeated ids pass through; texts of any length are encoded whole; an empty table gives an empty result;
    other columns are ignored.
    """
    model = load_model(docs.sparkSession, path)
    encoded = docs.select(F.col(id_col), encode_pieces(F.col(text_col), model).alias("ids"))
    return encoded.select(id_col, "ids", decode_pieces(F.col("ids"), model).alias("decoded"))
