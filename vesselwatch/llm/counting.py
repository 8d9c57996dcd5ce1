"""Token counts by finite-state transducers compiled from a tokenizer file.

Two transducers stand in a row. The *splitter* reads classes of characters and marks where words begin. Its few states
span a small monoid of state maps: a map for each chunk of text is the product of its characters' maps, chunks are
composed by a parallel prefix scan, and every character's state follows at once, whatever lies before its chunk.

The *counter* reads a word's bytes. After a prefix its state holds the places where a token may still be open: the node of the
vocabulary's trie reached from there, the last token before it and how many tokens fewer or more that makes. A byte leads to one
next state, so the machine is deterministic; its transition carries the change in the number of tokens, and what the
word has if it ends there. Transitions are compiled when they are first taken and kept in a table that all words of a batch
walk through in step.

It rests on two facts about merges in a fixed order: what is left of a token's end is encoded as if it stood alone, and a
sequence of tokens is an encoding if each two neighbours are. Two neighbours are one if no merge across their border would
have come before the merges that used up its parts.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselwatch.llm.common import bounded_batches
from vesselwatch.llm.packing import _byte_letters

#: Characters of a text that are handled at a time (more only where no blank allows a cut), and of a chunk.
SPAN, CHUNK = 1 << 20, 256
#: Transitions that the counter's table holds (of twice as many slots and more), and words that walk through it in step.
TRANSITIONS, SLOT_BITS, LANES = 600_000, 21, 1 << 15
#: Bytes from which on a word walks by itself.
LONG_WORD = 192
#: The word pattern and the normaliser that the splitter stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = ["NFC", "Replace", "Lowercase"]

#: Fixed values of Unicode 16 and 17, which Python's tables may lack yet: ranges of letters and of numbers, and (first, last, first lower-case one) of capitals.
NEWER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEWER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
NEWER_CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB),
    (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
_NEWER_LOWER = {first + k: lower + k for first, last, lower in NEWER_CAPITALS for k in range(last - first + 1)}
_HAS_NEWER = re.compile("[" + "".join(f"{chr(first)}-{chr(last)}" for first, last, _ in NEWER_CAPITALS) + "]").search

# --- the splitter ---------------------------------------------------------------------------------------------

#: Classes of characters: white space, letters (those that end or begin an ending such as 're apart), numbers, the rest.
BLANK, LETTER, NUMBER, OTHER, APOSTROPHE, ENDING, OPENS_E, ELL, E = range(9)
#: States: between words, in letters, in other characters, behind a first apostrophe, behind 'r or 'v, behind 'l.
BETWEEN, LETTERS, OTHERS, QUOTE, QUOTE_RV, QUOTE_L = range(6)
#: Marks of a transition: a word begins with this character; with the one before.
HERE, BEFORE = 1, 2


def _compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by class and state."""
    into, marks = np.zeros((9, 6), np.uint8), np.zeros((9, 6), np.uint8)
    alone = {BLANK: (BETWEEN, 0), NUMBER: (BETWEEN, HERE), OTHER: (OTHERS, HERE), APOSTROPHE: (QUOTE, HERE)}
    for c in range(9):
        fresh = alone.get(c, (LETTERS, HERE))
        for s in range(6):
            to, mark = fresh
            if s == LETTERS and c in (LETTER, ENDING, OPENS_E, ELL, E):
                to, mark = LETTERS, 0
            elif s in (OTHERS, QUOTE) and c in (OTHER, APOSTROPHE):
                to, mark = OTHERS, 0
            elif s == QUOTE and c in (ENDING, OPENS_E, ELL):
                to, mark = {ENDING: BETWEEN, OPENS_E: QUOTE_RV, ELL: QUOTE_L}[c], 0
            elif (s, c) in ((QUOTE_RV, E), (QUOTE_L, ELL)):
                to, mark = BETWEEN, 0
            elif s in (QUOTE_RV, QUOTE_L):  # no ending: a word of letters began with the r, v or l
                to, mark = (LETTERS, BEFORE) if c in (LETTER, ENDING, OPENS_E, ELL, E) else (to, mark | BEFORE)
            into[c, s], marks[c, s] = to, mark
    return into, marks


def _monoid(into: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each class's map, maps, product of any two): all state maps that texts can have."""
    number: dict[bytes, int] = {bytes(range(into.shape[1])): 0}
    maps = [np.arange(into.shape[1], dtype=np.uint8)]
    for m in maps:  # grows meanwhile
        for c in range(len(into)):
            if (key := into[c][m].tobytes()) not in number:
                number[key] = len(maps)
                maps.append(into[c][m])
    product = np.array([[number[b[a].tobytes()] for b in maps] for a in maps], np.uint8)
    if len(maps) > 255:
        raise ValueError("too many state maps")
    return np.array([number[row.tobytes()] for row in into], np.uint8), np.array(maps), product


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            out[code] = LETTER if kind == "L" else NUMBER
    for kind, ranges in ((LETTER, NEWER_LETTERS), (NUMBER, NEWER_NUMBERS)):
        for first, last in ranges:
            out[first : last + 1] = kind
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    for letters, kind in (("'", APOSTROPHE), ("stmd", ENDING), ("rv", OPENS_E), ("l", ELL), ("e", E)):
        out[[ord(c) for c in letters]] = kind
    return out


class Splitter:
    def __init__(self) -> None:
        into, self.marks = _compile_splitter()
        self.letter, self.maps, self.product = _monoid(into)
        self.flat_product, self.flat_marks, self.width = self.product.ravel(), self.marks.ravel(), len(self.maps)

    def starts(self, kinds: np.ndarray) -> np.ndarray:
        """Whether a word begins, for each character; the last one is white space."""
        n = -(-len(kinds) // CHUNK)
        grid = np.zeros(n * CHUNK, np.uint8)
        grid[: len(kinds)] = kinds
        grid = np.ascontiguousarray(grid.reshape(n, CHUNK).T)
        letters = self.letter[grid]
        before = np.empty((CHUNK, n), np.uint8)
        now = np.zeros(n, np.uint8)
        for k in range(CHUNK):
            before[k] = now
            now = self.flat_product[now.astype(np.int32) * self.width + letters[k]]
        step = 1
        while step < n:  # afterwards: the map of all text up to each chunk's end
            now = np.concatenate([now[:step], self.flat_product[now[:-step].astype(np.int32) * self.width + now[step:]]])
            step *= 2
        entry = np.concatenate([[BETWEEN], self.maps[now[:-1], BETWEEN]]).astype(np.int32)
        state = self.maps.ravel()[before * np.int32(6) + entry]
        marks = self.flat_marks[grid * np.int32(6) + state].T.ravel()[: len(kinds)]
        found = (marks & HERE).astype(bool)
        found[:-1] |= (marks[1:] & BEFORE).astype(bool)
        return found


# --- the counter ----------------------------------------------------------------------------------------------


class Counter:
    """Numbers of tokens of words, by merges in a fixed order over bytes, the last of which bears the end mark."""

    def __init__(self, merges: list[tuple[bytes, bool, bytes, bool]]):
        """``merges``: (left, right) with a flag each for the end mark. Symbols: byte b is b, with the mark 256 + b."""
        number: dict[tuple[bytes, bool], int] = {(bytes([b]), end): b + 256 * end for b in range(256) for end in (False, True)}
        self.birth, self.parts, self.merge = [-1] * 512, [(-1, -1)] * 512, {}
        for rank, (a, a_end, b, b_end) in enumerate(merges):
            left, right = number[a, a_end], number[b, b_end]
            if a_end or (a + b, b_end) in number:
                raise ValueError("a token that two merges make, or that goes on behind a word's end")
            self.merge[left << 20 | right] = rank
            number[a + b, b_end] = len(self.birth)
            self.birth.append(rank)
            self.parts.append((left, right))
        self._spines()
        # tokens of their own encoding only: others never occur
        usable = [t < 512 or self._first_across(*self.parts[t]) == self.birth[t] for t in range(len(self.birth))]
        self.children: list[dict[int, int]] = [{}]
        self.token, self.final = [-1], [{}]
        for (text, end), t in number.items():
            if not usable[t]:
                continue
            node = 0
            for b in text[:-1] if end else text:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                    self.final.append({})
                node = self.children[node][b]
            if end:
                self.final[node][text[-1]] = t
            else:
                self.token[node] = t
        self.open = [bool(c or f) for c, f in zip(self.children, self.final, strict=True)]
        self._clear([((0, -1, 0),)])

    def _spines(self) -> None:
        """By token: parts at its right (left) edge with the rank of the merge that used each up."""
        never = 1 << 60
        self.right_edge, self.left_edge = [], []
        for side, edges in ((1, self.right_edge), (0, self.left_edge)):
            for t in range(len(self.birth)):
                edge, used = [], never
                while t >= 0:
                    edge.append((t, used))
                    used, t = self.birth[t], self.parts[t][side]
                edges.append(edge)

    def _first_across(self, u: int, t: int) -> int | None:
        """Rank of the first merge across the border of two tokens, None if there is none.

        Of a run of equal symbols the leftmost two merge: on a tie the left part is used up already, the right one isn't.
        """
        found = None
        for x, x_used in self.right_edge[u]:
            for y, y_used in self.left_edge[t]:
                rank = self.merge.get(x << 20 | y)
                if rank is not None and rank < x_used and rank <= y_used and (found is None or rank < found):
                    found = rank
        return found

    def _clear(self, states: list[tuple]) -> None:
        """An empty table that knows ``states`` (numbers in their order)."""
        self.keys, self.values = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, np.int64)
        self.states, self.number, self.held = list(states), {s: k for k, s in enumerate(states)}, 0

    def _compile(self, state: int, byte: int) -> int:
        """Entry: next state, change of the count + 128 (bits 32 on), count with the word's end here relative to now + 128 (bits 40 on)."""
        last, ends, kept = None, None, []
        for node, before, rel in self.states[state]:
            child = self.children[node].get(byte)
            if child is not None:
                t = self.token[child]
                if last is None and t >= 0 and (before < 0 or self._first_across(before, t) is None):
                    last, change = t, rel + 1
                if self.open[child]:
                    kept.append((child, before, rel))
            t = self.final[node].get(byte)
            if ends is None and t is not None and (before < 0 or self._first_across(before, t) is None):
                ends = rel + 1
        after = (*((child, before, rel - change) for child, before, rel in kept), (0, last, 0))
        to = self.number.get(after)
        if to is None:
            to = self.number[after] = len(self.states)
            self.states.append(after)
        return to | (change + 128) << 32 | (ends + 128) << 40

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        """Entries of the table, 0 where there is none; the next slot is tried where another key lies."""
        slot = _slots(keys)
        there = self.keys[slot]
        found = np.where(there == keys, self.values[slot], 0)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << SLOT_BITS) - 1)
            there = self.keys[slot[rest]]
            hit = there == keys[rest]
            found[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return found

    def _learn(self, missing: np.ndarray) -> None:
        for key, slot in zip(missing.tolist(), _slots(missing).tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << SLOT_BITS) - 1)
            self.keys[slot], self.values[slot] = key, self._compile(key >> 8, key & 255)
        self.held += len(missing)

    def _entries(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, states): the table is begun anew with the states at hand when it is full."""
        keys = state << 8 | byte
        found = self._look_up(keys)
        missing = np.unique(keys[found == 0])
        if len(missing):
            if self.held + len(missing) > TRANSITIONS:
                live, place = np.unique(state, return_inverse=True)
                states = list(dict.fromkeys([((0, -1, 0),), *(self.states[s] for s in live.tolist())]))
                number = {s: k for k, s in enumerate(states)}
                state = np.array([number[self.states[s]] for s in live.tolist()], np.int64)[place]
                self._clear(states)
                keys = state << 8 | byte
                missing = np.unique(keys)
            self._learn(missing)
            found = self._look_up(keys)
        return found, state

    def counts(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each word of ``data``."""
        out = np.zeros(len(starts), np.int64)
        for k in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[k] = self._walk(data[starts[k] : starts[k] + sizes[k]])
        short = np.flatnonzero(sizes <= LONG_WORD)
        for lo in range(0, len(short), LANES):
            rows = short[lo : lo + LANES]
            rows = rows[np.argsort(-sizes[rows].astype(np.int16), kind="stable")]
            out[rows] = self._in_step(data, starts[rows], sizes[rows])
        return out

    def _in_step(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``sizes`` falls: words that go on are the first ones."""
        total, state = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        active = len(starts)
        for k in range(int(sizes[0]) if active else 0):
            going = int(np.searchsorted(-sizes[:active], -(k + 1), side="left"))  # words of more than k + 1 bytes
            found, state = self._entries(state[:active], data[starts[:active] + k])
            total[going:active] += (found[going:] >> 40) - 128
            total[:going] += (found[:going] >> 32 & 255) - 128
            state, active = found[:going] & 0xFFFFFFFF, going
        return total

    def _walk(self, word: np.ndarray) -> int:
        """A long word by itself: its transitions lie in a plain dictionary, which is emptied as the table is."""
        state, total, known = 0, 0, {}
        for b in word.tolist()[:-1]:
            found = known.get(state << 8 | b)
            if found is None:
                if len(known) > TRANSITIONS or len(self.states) > 2 * TRANSITIONS:
                    here = self.states[state]
                    self._clear(list(dict.fromkeys([((0, -1, 0),), here])))
                    state, known = self.number[here], {}
                found = known[state << 8 | b] = self._compile(state, b)
            total += (found >> 32 & 255) - 128
            state = found & 0xFFFFFFFF
        return total + (self._compile(state, int(word[-1])) >> 40) - 128


def _slots(keys: np.ndarray) -> np.ndarray:
    """Where keys are first looked for: the upper bits of a product."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class TokenCounter:
    """Numbers of tokens of texts, for a tokenizer file (JSON) of merges with an end-of-word mark."""

    def __init__(self, data: bytes):
        file = json.loads(data)
        model, steps = file["model"], file["pre_tokenizer"]["pretokenizers"]
        if (
            model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or not model["end_of_word_suffix"]
            or [n["type"] for n in file["normalizer"]["normalizers"]] != NORMALIZER or file["normalizer"]["normalizers"][1]["pattern"] != {"Regex": r"\s+"}
            or [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[0]["pattern"] != {"Regex": PATTERN} or not steps[0]["invert"] or steps[0]["behavior"] != "Removed"
            or steps[1]["use_regex"] or steps[1]["add_prefix_space"] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"])
        ):
            raise ValueError("only lower-casing tokenizers with this pattern and an end-of-word mark are supported")
        spelled, mark = {c: b for b, c in _byte_letters().items()}, model["end_of_word_suffix"]
        part = lambda s: (bytes(spelled[c] for c in s.removesuffix(mark)), s.endswith(mark))
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.counter, self.splitter = Counter([(*part(a), *part(b)) for a, b in merges]), Splitter()
        self.added = [t["content"] for t in file["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        pieces: list[str] = []
        owners: list[int] = []
        held = 0
        for k, text in enumerate(texts):
            segments = [text]
            if self.cut is not None and any(t in text for t in self.added):  # each is a token, what lies between stands alone
                segments = self.cut.split(text)
                out[k] += len(segments) - 1
            for segment in segments:
                for piece in _spans(segment):
                    piece = _lowered(piece)
                    pieces.append(piece)
                    owners.append(k)
                    held += len(piece)
                    if held > SPAN:
                        self._add(out, pieces, owners)
                        pieces, owners, held = [], [], 0
        if pieces:
            self._add(out, pieces, owners)
        return out

    def _add(self, out: np.ndarray, pieces: list[str], owners: list[int]) -> None:
        text = "\n".join(pieces) + "\n"
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds = _classes()[codes]
        begins = self.splitter.starts(kinds)
        borders = np.flatnonzero(begins | (kinds == BLANK))
        first = np.flatnonzero(begins[borders])
        starts, ends = borders[first], borders[first + 1]  # the last border is the blank at the end
        piece_ends = np.cumsum([len(p) + 1 for p in pieces])
        owner = np.array(owners)[np.searchsorted(piece_ends, starts, side="right")]
        if text.isascii():
            data = codes.astype(np.uint8)
        else:
            data = np.frombuffer(text.encode(), np.uint8)
            offset = np.concatenate(([0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))))
            starts, ends = offset[starts], offset[ends]
        np.add.at(out, owner, self.counter.counts(data, starts, ends - starts))


def _lowered(text: str) -> str:
    """Composed and lower-cased, character by character: there is no final sigma."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return (text.translate(_NEWER_LOWER) if _HAS_NEWER(text) else text).lower()


def _spans(text: str) -> Iterator[str]:
    """Parts of about ``SPAN`` characters, cut before a plain blank or line end, which no word and no composition crosses."""
    at = 0
    while len(text) - at > SPAN:
        cut = max(text.rfind(" ", at + 1, at + SPAN), text.rfind("\n", at + 1, at + SPAN))
        if cut < 0:
            cuts = [c for c in (text.find(" ", at + SPAN), text.find("\n", at + SPAN)) if c >= 0]
            cut = min(cuts, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


@lru_cache(2)
def _counter(data: bytes) -> TokenCounter:
    return TokenCounter(data)


def load_tokenizer(spark: SparkSession, path: str):
    """The tokenizer file as a broadcast value (its size is that of a vocabulary file, whatever the data)."""
    bounded_batches(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def count_tokens(text: Column, tokenizer) -> Column:
    """long: tokens of a text without begin and end; null and empty texts have none."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(_counter(tokenizer.value)(texts.to_pylist()), pa.int64())

    return F.arrow_udf(run, "long")(F.coalesce(text, F.lit("")))


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    Defined cases: a null text counts as the empty one (0 bytes, 0 tokens, not over the limit); null and repeated ids
    pass through, a row each; texts of any length are counted whole; the strings of added tokens inside a text are one token each;
    an empty table gives an empty result; other columns are ignored.
    """
    tokenizer = load_tokenizer(docs.sparkSession, path)
    counted = docs.select(id_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), count_tokens(F.col(text_col), tokenizer).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
