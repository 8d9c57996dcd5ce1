"""Near duplicates against all pairs of full shingle sets."""

import random

import pytest
from pyspark.sql import functions as F
from tests_llm_helpers import brute_components
from vesselwatch.llm import common, minhash
from vesselwatch.llm.common import connected_components
from vesselwatch.llm.minhash import near_duplicates, odd_sketch, shingle_hashes, words


def _corpus(n, seed):
    """Families of copies with a few to many changed words, exact copies, a shared passage, odd texts."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(800)] + ["The", "of", "and"] * 40
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for k in range(n):
        kind = rng.random()
        if kind < 0.6 and rows:
            base = (rng.choice(rows)[1] or "x").split()
            for _ in range(rng.randrange(1 + len(base) // 8)):
                base[rng.randrange(len(base))] = rng.choice(vocab)
            rows.append((k, " ".join(base) or None))
        elif kind < 0.75:
            rows.append((k, " ".join(passage + [rng.choice(vocab) for _ in range(rng.randrange(12))])))
        else:
            rows.append((k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 150)))))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "Word"), (n + 4, "wORD\n"), (n + 5, "a b"), (n + 6, "A\tB"), (n + 7, "É"), (n + 8, "é")]


@pytest.mark.parametrize(("width", "seed", "exact"), [(2, 1, False), (5, 2, False), (2, 3, True)])
def test_equals_all_pairs(spark, width, seed, exact):
    rows = _corpus(300, seed)
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=width, exact=exact).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out} == brute_components(rows, width, 80)
    assert len(out) == len(rows)


def _at_the_threshold(pairs, size, rng):
    """Pairs of one-word-shingle sets with a similarity of exactly 0.8: 4/5 of the union shared."""
    rows = []
    for k in range(pairs):
        names = [f"{k}x{rng.randrange(10**9)}y{j}" for j in range(size)]
        tenth = size // 10
        rows += [(2 * k, " ".join(names[:-tenth])), (2 * k + 1, " ".join(names[tenth:]))]
    return rows


@pytest.mark.parametrize("exact", [False, True])
def test_recall_at_exactly_the_threshold(spark, exact):
    rows = _at_the_threshold(1500, 50, random.Random(6))
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), width=1, exact=exact).collect()
    assert sum(not r["kept"] for r in out) == 1500  # by signatures alone 4 of 1,000,000 are missed


@pytest.mark.parametrize("block", [2, 512])
def test_keys_that_stay_open_are_paired_in_blocks(spark, block, monkeypatch):
    """Texts that share most words with a common one, but less than the threshold with each other."""
    rng = random.Random(8)
    monkeypatch.setattr(minhash, "BLOCK", block)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(60):
        words_ = base[:]
        for at in rng.sample(range(60), 8 + k % 3):
            words_[at] = f"n{k}x{at}"
        rows.append((k, " ".join(words_)))
        if k % 5 == 0:
            rows.append((100 + k, " ".join(words_[:-1])))
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=1).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out} == brute_components(rows, 1, 80)


def test_long_texts_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(common.group_join, "__defaults__", (3, 100_000, True))
    rng = random.Random(10)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(30_000))
    rows = [(k, "the same words") for k in range(50)] + [(60, long), (61, long + " end"), (62, None), (63, "")]
    out = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(out) == len(rows) and all(out[k] == (0, k == 0) for k in range(50))
    assert (out[60], out[61], out[62], out[63]) == ((60, True), (60, False), (62, True), (63, True))


def test_defined_cases(spark):
    rows = [(1, "a b c", 7, None), (None, "a b c", 8, "x"), (1, "a b c", 9, None), (5, "A  b C", 1, None), (7, None, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long, cls string")
    got = sorted(map(tuple, near_duplicates(df, width=2).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (5, 2, 1, False), (7, 0, 7, True)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_sketches_never_exceed_the_difference():
    rng = random.Random(4)
    for _ in range(50):
        a = [f"{rng.randrange(400)}" for _ in range(300)]
        b = a[:200] + [f"{rng.randrange(400)}" for _ in range(80)]
        x, y = (shingle_hashes(words(" ".join(t)), 1, _Hash()) for t in (a, b))
        differ = sum(bin(p ^ q).count("1") for p, q in zip(odd_sketch(x), odd_sketch(y), strict=True))
        assert differ <= len(set(a) ^ set(b))


class _Hash(dict):
    def __missing__(self, w):
        import xxhash

        return xxhash.xxh3_64_intdigest(w)


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(500, 500)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            u, v = find(a), find(b)
            root[max(u, v)] = min(u, v)
    df = spark.createDataFrame(edges, "a long, b long").select("a", "b", F.lit(1).alias("u"))
    for hub in (1_000_000, 10):
        assert {r["node"]: r["component"] for r in connected_components(df, hub=hub).collect()} == {x: find(x) for x in root}
    assert connected_components(df.limit(0)).count() == 0
