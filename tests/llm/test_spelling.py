"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

from vesselwatch.llm import spelling
from vesselwatch.llm.spelling import Automaton, WordCounts, spelling_variants


def _counts(rows) -> Counter:
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return counts


def _brute(rows) -> dict:
    words = {w: n for w, n in _counts(rows).items() if len(w) >= 5 and n >= 3}
    groups = defaultdict(set)
    for w in words:
        groups[len(w), w, None].add(w)
        for k in range(len(w)):
            groups[len(w), w[:k], w[k + 1 :]].add(w)  # any character at k
            groups[len(w) - 1, w[:k] + w[k + 1 :], None].add(w)
    near = defaultdict(set)
    for (size, _, rest), members in groups.items():
        for a in members:
            near[a] |= {b for b in members if a != b and (len(a) == len(b) if rest is not None else size in (len(a), len(b)) and len(a) != len(b))}
    out = {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in near[w]), default=(0, None))
        form = best[1] if best[1] and -best[0] >= 2 * n else None
        out[w] = (form, n, len(near[w]), words.get(form))

    def root(w: str) -> str:
        while out[w][0]:
            w = out[w][0]
        return w

    return {w: (form, root(w), *rest) for w, (form, *rest) in out.items()}


def _rows() -> list[tuple]:
    rng = random.Random(2)
    parts = ["a", "b", "B", "ab", "é", "É", "×", " ", " ", "1", "aaa", "ba"]
    rows = [(i if i % 50 else None, "".join(rng.choice(parts) for _ in range(rng.randrange(300)))) for i in range(200)]
    return [*rows, (1, None), (2, ""), (3, "A" * 300 + " " + "A" * 300), (4, "A" * 300 + " " + "A" * 299), (5, "A" * 299 + " " + "a" * 299)]


def test_results_equal_brute_force_whatever_the_blocks(spark):
    rows = _rows()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n string")
    want = _brute(rows)
    assert sum(v[0] is not None for v in want.values()) > 20
    for block in (20_000, 7):
        found = spelling_variants(docs, block=block).collect()
        assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found} == want


def test_empty_table_and_texts_without_words(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, None), (2, "12 !")], "doc_id long, text string")).count() == 0


def test_checksums_put_together_from_parts(monkeypatch):
    rows = [*_rows(), (-5, "hello " * 50 + "w" * 200), (10**15, "word Word WORD " * 40)]
    monkeypatch.setattr(spelling, "SPAN", 64)
    counts = WordCounts()
    for k in range(0, len(rows), 17):
        part = rows[k : k + 17]
        counts.add([d for d, _ in part], [t or "" for _, t in part])
    found = Counter()
    for batch in counts.batches(1):
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found[word] += n
    want = _counts(rows)
    del want[""]
    assert found == want


def test_automaton_is_minimal_and_numbers_its_words():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    automaton = Automaton(words)
    for k, word in enumerate(words):
        state, number = automaton.walk(automaton.start, 0, word)
        assert automaton.final[state] and number == k
    follow = lambda s: frozenset([""] * automaton.final[s] + [c + rest for c, (to, _) in automaton.edges[s].items() for rest in follow(to)])
    languages = [follow(s) for s in range(len(automaton.edges))]
    assert len(set(languages)) == len(languages) and follow(automaton.start) == set(words)


def test_one_error_finds_each_word_once():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("aab") for _ in range(rng.randrange(2, 8))) for _ in range(200)})
    automaton = Automaton(words)

    def edits(w):
        out = {w[:k] + w[k + 1 :] for k in range(len(w))}
        for c in "ab":
            out |= {w[:k] + c + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k:] for k in range(len(w) + 1)}
        return out - {w}

    for word in words:
        exact = len(word) // 2
        found = [words[k] for k in automaton.one_error(word, exact)]
        assert len(found) == len(set(found))
        assert set(found) == {w for w in words if w in edits(word) and w[:exact] == word[:exact]}
