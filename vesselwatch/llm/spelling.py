"""Spelling variants: words one insertion, deletion or replacement apart, and the commoner form that each follows.

Words lie in minimal acyclic automata, which number the words they hold (a perfect hash), once read forward and once
backward. Of two words one edit apart either the first half of one is the beginning of the other, or its second half
is the other's end. So a word walks its half exactly, in either direction, and completes the rest with one error.
A pair that both directions find counts in the forward one only.

The vocabulary is dealt out by halves: a word is looked up among the words that have the same half, and lies there under
the two lengths of half that words of about its length have. A group of one half is an automaton of its own in one task; groups
of more than ``BLOCK`` words are cut into blocks, each block of words meeting each block of look-ups.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselwatch.llm.common import bounded_batches, materialize, small_enough

#: What a run is; one in so many runs loses a character.
RUN, BROKEN = "[A-Za-zÀ-ÿ]+", 97
#: Characters of a text that are searched at a time.
SPAN = 1 << 20
#: Distinct runs (and characters of them) that a task counts before it passes the counts on.
HELD, HELD_CHARACTERS = 400_000, 16_000_000
#: Bytes of runs whose checksums are put together from parts.
SHORT = 64
#: Words of a group that lie in one automaton.
BLOCK = 20_000

_RUNS, _GAP = re.compile(RUN), re.compile(RUN.replace("[", "[^", 1).removesuffix("+"))
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})

# --- counting words -------------------------------------------------------------------------------------------


def _runs(text: str) -> Iterator[list[str]]:
    """Lower-cased runs of a text, piece by piece; a piece ends where no run does."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + SPAN) if len(text) - at > SPAN else None
        end = gap.start() if gap else len(text)
        part = text[at:end]
        yield _RUNS.findall(part.lower() if part.isascii() else part.translate(_LOWER))
        at = end


class _Numbers(dict):
    """Numbers of runs in the order of their first use."""

    def __missing__(self, run: str) -> int:
        self[run] = number = len(self)
        return number


#: What a zero byte does to the lower byte of a checksum's linear part.
_ZERO_BYTE = np.array([zlib.crc32(b"\0", k) ^ zlib.crc32(b"\0") for k in range(256)], np.uint32)


class WordCounts:
    """Counts of words. A run's checksum behind ``<id>:`` is its own one combined with that of the beginning.

    Checksums are linear: for ``n`` bytes that follow, the beginning's one is moved on by ``n`` zero bytes.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.numbers, self.known = _Numbers(), 0
        self.sums, self.sizes, self.counts = (np.zeros(1024, t) for t in (np.uint32, np.int64, np.int64))
        self.broken: dict[str, int] = {}
        self.characters = 0

    def full(self) -> bool:
        return len(self.numbers) + len(self.broken) > HELD or self.characters > HELD_CHARACTERS

    def _learn(self) -> None:
        n = len(self.numbers)
        if n > len(self.sums):
            grow = lambda a: np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])
            self.sums, self.sizes, self.counts = grow(self.sums), grow(self.sizes), grow(self.counts)
        self.names = list(self.numbers)
        for k in range(self.known, n):
            data = self.names[k].encode()
            self.sums[k], self.sizes[k] = zlib.crc32(data), len(data)
            self.characters += len(self.names[k])
        self.known = n

    def add(self, ids: list, texts: list[str]) -> None:
        look = self.numbers.__getitem__
        codes: list[int] = []
        owners: list[int] = []
        ends: list[int] = []
        for doc, text in zip(ids, texts, strict=True):
            for runs in _runs(text):
                codes += map(look, runs)
                owners.append(zlib.crc32(b":" if doc is None else b"%d:" % doc))
                ends.append(len(codes))
                if len(codes) > SPAN:
                    self._count(np.array(codes, np.int64), owners, ends)
                    codes, owners, ends = [], [], []
        self._count(np.array(codes, np.int64), owners, ends)

    def _count(self, codes: np.ndarray, owners: list[int], ends: list[int]) -> None:
        if not len(codes):
            return
        self._learn()
        piece = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
        beginning, sizes = np.array(owners, np.uint32), self.sizes[codes]
        moved = np.empty((min(SHORT, int(sizes.max())) + 1, len(ends)), np.uint32)
        moved[0] = beginning
        for k in range(1, len(moved)):
            moved[k] = _ZERO_BYTE[moved[k - 1] & 255] ^ (moved[k - 1] >> 8)
        short = sizes <= SHORT
        sums = self.sums[codes] ^ moved[np.where(short, sizes, 0), piece]
        for k in np.flatnonzero(~short).tolist():
            sums[k] = zlib.crc32(self.names[codes[k]].encode(), owners[piece[k]])
        breaks = sums % BROKEN == 0
        self.counts[: self.known] += np.bincount(codes[~breaks], minlength=self.known)
        for k in np.flatnonzero(breaks).tolist():
            run = self.names[codes[k]]
            at = int(sums[k]) % len(run)
            word = run[:at] + run[at + 1 :]
            if word not in self.broken:
                self.characters += len(word)
            self.broken[word] = self.broken.get(word, 0) + 1

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        """(word, n) of the words of at least so many characters; a word may come twice."""
        found = [(w, n) for w, n in zip(self.numbers, self.counts.tolist(), strict=False) if n and len(w) >= least]
        found += [(w, n) for w, n in self.broken.items() if len(w) >= least]
        for lo in range(0, len(found), 20_000):
            words, counts = zip(*found[lo : lo + 20_000], strict=True)
            yield pa.record_batch([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5, occurrences: int = 3) -> DataFrame:
    """(word, n) of words of at least ``length`` characters and ``occurrences`` occurrences."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts()
        for batch in batches:
            counts.add(batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()])
            if counts.full():
                yield from counts.batches(length)
                counts.clear()
        yield from counts.batches(length)

    counted = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


# --- automata -------------------------------------------------------------------------------------------------


class Automaton:
    """The minimal acyclic automaton of words in rising order. ``edges[s]``: by character (state, words that come before)."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._sizes: list[int] = []
        self._same: dict[tuple, int] = {}
        ends, branches = [False], [[]]  # of the states along the last word
        last = ""
        for word in words:
            common = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                common += 1
            self._close(last, common, ends, branches)
            for _ in range(len(word) - common):
                ends.append(False)
                branches.append([])
            ends[-1] = True
            last = word
        self._close(last, 0, ends, branches)
        self.start = self._state(ends[0], branches[0])
        del self._same, self._sizes

    def _close(self, word: str, depth: int, ends: list[bool], branches: list[list]) -> None:
        while len(ends) > depth + 1:
            state = self._state(ends.pop(), branches.pop())
            branches[-1].append((word[len(ends) - 1], state))

    def _state(self, final: bool, branches: list[tuple[str, int]]) -> int:
        """The state with these branches, the same one wherever what follows is the same."""
        key = (final, *branches)
        state = self._same.get(key)
        if state is None:
            state = self._same[key] = len(self.edges)
            before, edges = int(final), {}
            for c, to in branches:
                edges[c] = (to, before)
                before += self._sizes[to]
            self.edges.append(edges)
            self.final.append(final)
            self._sizes.append(before)
        return state

    def walk(self, state: int, number: int, text: str) -> tuple[int, int] | None:
        edges = self.edges
        for c in text:
            step = edges[state].get(c)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def _ends(self, state: int, number: int, text: str) -> int | None:
        """Number of the word that goes on with exactly ``text``."""
        found = self.walk(state, number, text)
        return found[1] if found and self.final[found[0]] else None

    def one_error(self, word: str, exact: int) -> Iterator[int]:
        """Numbers of the words that begin with the first ``exact`` characters and differ by one edit behind them, each once.

        Of equal edits in a run of one character, the deletion of its first and the insertion behind its last one are taken.
        """
        here = self.walk(self.start, 0, word[:exact])
        if here is None:
            return
        state, number = here
        for k in range(exact, len(word) + 1):
            c = word[k] if k < len(word) else ""
            for other, (to, before) in self.edges[state].items():
                if other == c:
                    continue
                for rest in (word[k:], word[k + 1 :]) if c else ("",):  # an insertion, a replacement
                    if not rest or rest[0] in self.edges[to]:
                        found = self._ends(to, number + before, rest)
                        if found is not None:
                            yield found
            if not c:
                return
            if k == exact or word[k - 1] != c:
                found = self._ends(state, number, word[k + 1 :])
                if found is not None:
                    yield found
            step = self.edges[state].get(c)
            if step is None:
                return
            state, number = step[0], number + step[1]


def _dealt(words: DataFrame) -> DataFrame:
    """(backward, size, half, text, n, asks) for each half that a word lies under; with ``asks`` it is looked up there."""
    length = F.char_length("word")
    half, odd = F.floor(length / 2).cast("int"), length % 2 == 1
    place = lambda backward, size, asks: F.struct(F.lit(backward).alias("backward"), size.alias("size"), F.lit(asks).alias("asks"))
    places = [
        place(False, half, True),
        place(False, F.when(odd, half + 1).otherwise(half - 1), False),
        place(True, F.when(odd, half + 1).otherwise(half), True),
        place(True, F.when(odd, half).otherwise(half + 1), False),
    ]
    text = F.when(F.col("p.backward"), F.reverse("word")).otherwise(F.col("word"))
    rows = words.select("n", "word", F.explode(F.array(*places)).alias("p")).select("p.*", "n", text.alias("text"))
    return rows.select("backward", "size", F.xxhash64(F.substring("text", F.lit(1), F.col("size"))).alias("half"), "text", "n", "asks")


def _answers(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["backward", "size", "half", "block", "ask_block", "text", "n", "asks", "lies"]
    out: list[tuple] = []
    for (backward, size, *_), group in groupby((r for b in rows for r in zip(*(b.column(c).to_pylist() for c in names), strict=True)), itemgetter(0, 1, 2, 3, 4)):
        members = list(group)
        if len(members) < 2:
            continue
        lying = [(r[5], r[6]) for r in members if r[8]]
        automaton = Automaton([t for t, _ in lying])
        for text in (r[5] for r in members if r[7]):
            near, best = 0, None
            for k in automaton.one_error(text, size):
                other, n = lying[k]
                rest = len(text) - size
                if backward and other[len(other) - rest :] == text[size:]:
                    continue  # the first half agrees too: found forward
                near += 1
                key = (-n, other[::-1] if backward else other)
                if best is None or key < best:
                    best = key
            if near:
                out.append((text[::-1] if backward else text, near, *best))
        if len(out) > 10_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["word", "near", "less", "form"])


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form, form_n): the number of words one edit away and the commonest of them; words without any have no row.

    ``words``: distinct ``word`` of two characters or more, with ``n``.
    """
    bounded_batches(words.sparkSession)
    rows, group = _dealt(words), ["backward", "size", "half"]
    hot = rows.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    hot = materialize(hot, "hot-halves")
    whole = rows.select("*", F.lit(0).alias("block"), F.lit(0).alias("ask_block"), F.lit(True).alias("lies"))
    if not hot.isEmpty():
        hot = F.broadcast(hot) if small_enough(hot, 100_000) else hot
        cut = rows.join(hot, group).withColumn("mine", F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int"))
        each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        lying = cut.select("*", F.col("mine").alias("block"), each.alias("ask_block"), F.lit(True).alias("lies")).withColumn("asks", F.lit(False))
        asking = cut.where("asks").select("*", each.alias("block"), F.col("mine").alias("ask_block"), F.lit(False).alias("lies"))
        whole = whole.join(hot, group, "left_anti").unionByName(lying.unionByName(asking).drop("blocks", "mine"))
    cells = [*group, "block", "ask_block"]
    found = whole.repartition(*cells).sortWithinPartitions(*cells, "text").mapInArrow(_answers, "word string, near long, less long, form string")
    best = F.min(F.struct("less", "form"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by levels down from the words without a form: as counts at least double from word to form, there are few.

    A level's join is by form, of which at most one edit's worth of words have the same.
    """
    known = forms.where("form is null").select("word", F.col("word").alias("root"))
    levels, pending = [known], forms.where("form is not null").select("word", "form")
    while True:
        above = levels[-1].select(F.col("word").alias("form"), "root")
        met = materialize(pending.join(above, "form", "left").select("word", "form", "root"), "roots")
        levels.append(met.where("root is not null").select("word", "root"))
        pending = met.where("root is null").select("word", "form")
        if pending.isEmpty():
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5, occurrences: int = 3, times: int = 2, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word; ``form`` is the commonest near word if it is at least ``times`` as common.

    Defined cases: null and empty texts have no words; a null id counts as the empty one in a run's checksum; repeated rows count
    as often as they stand there; of equally common near words the smallest in code-point order is the form; words
    of any length are compared whole; an empty table gives an empty result; other columns are ignored.
    """
    words = materialize(vocabulary(docs, id_col, text_col, length, occurrences), "words")
    near = near_words(words, block)
    likely = F.col("form_n") >= times * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", F.when(likely, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likely, F.col("form_n")).alias("form_n")
    )
    forms = materialize(forms, "forms")
    return forms.join(_roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")
