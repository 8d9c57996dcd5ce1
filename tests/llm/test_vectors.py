"""Embedding near-duplicates and exact top-k against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from vesselwatch.llm import embeddings
from vesselwatch.llm.embeddings import MultiIndex, embedding_duplicates
from vesselwatch.llm.topk import exact_top_k, search_block, summaries


def _vectors(n=600, width=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width))
    for k in range(n // 3, n):  # copies at varied cosines, some exact
        base = x[rng.integers(0, k)]
        x[k] = base * rng.uniform(0.5, 2) + rng.standard_normal(width) * np.linalg.norm(base) / 4 * rng.uniform(0, 0.6) * (rng.random() > 0.1)
    return x


@pytest.mark.parametrize(("target", "block", "most"), [(0.95, 4096, 16_384), (0.95, 64, 100), (1, 100, 64)])
def test_links_and_components(spark, monkeypatch, target, block, most):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "VISITORS", most)
    x = _vectors()
    rows = [(int(k), [float(v) for v in row]) for k, row in enumerate(x)]
    got = {r["vec_id"]: r for r in embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), target=target).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    links = np.array([got[k]["n_links"] for k in range(len(x))])
    assert (links <= near.sum(axis=1)).all()
    assert links.sum() >= (1 if target == 1 else 0.97) * near.sum()  # measured recall; the aim is 0.9
    label = np.arange(len(x))
    while True:
        new = np.array([min([label[k], *label[near[k]]]) for k in range(len(x))])
        if (new == label).all():
            break
        label = new
    same = sum(got[k]["component_id"] == label[k] for k in range(len(x)))
    assert same >= 0.97 * len(x)
    assert all(got[k]["kept"] == (got[k]["component_id"] == k) for k in got)


def test_the_reach_is_that_of_the_last_visit():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = MultiIndex(x, 9, 0.9, 0.9)
    a, b = index.to_centroids(x)
    total = (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)
    assert (np.sort(total, axis=1)[:, index.visits - 1] == index.reach(a, b)).all()
    assert (a == np.rint(a)).all() and (index.home(x) == total.argmin(axis=1)).all()
    assert MultiIndex(x, 9, 0.9, 1).visits == 81


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0, 0.0]), (3, None), (4, [0.0] * 4), (5, [nan, 1.0, 0.0, 0.0]), (6, [1.0, None, 0.0, 0.0]), (7, [inf, 0.0, 0.0, 0.0]), (8, []),
            (9, [1.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (10, [1.0, 0.0, 0.0, 0.0]), (11, [1e-200, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cls", F.lit("x"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_duplicates(df).collect()}
    for alone in (3, 4, 5, 6, 7, 8, 9):
        assert got[alone] == (0, alone, True)
    assert got[None] == (0, None, True)
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[10] == (3, 1, False) and got[11] == (3, 1, False)
    assert embedding_duplicates(df.limit(0)).count() == 0


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    x = np.floor(rng.standard_normal((500, 24)) * 300)
    x[100:140] = x[7]  # ties
    ids = rng.permutation(5000)[:500]
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in exact_top_k(df, F.col("vec_id") % 10 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {int(i) for i in ids if i % 10 == 0}
    for k in np.flatnonzero(ids % 10 == 0):
        s = x @ x[k]
        order = [j for j in np.lexsort((ids, -s)) if j != k][:10]
        assert got[int(ids[k])] == [(n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(order)]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((50, 30)) * 100
    for s in (1, 2, 4, 7, 30):
        f = summaries(x, s)
        assert (f @ f.T >= x @ x.T - 1e-6).all()


def test_few_candidates():
    x = np.array([[1.0, 2.0], [3.0, 4.0]])
    assert search_block(x, np.array([1, 2]), x, np.array([1, 2]), 10) == [(0, 2, 11), (1, 1, 11)]


def _best(rows, asks, k):
    """By Python's integers."""
    out = {}
    for i, v in rows:
        if asks(i):
            found = sorted(((-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i and len(w) == len(v)))[:k]
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return out


@pytest.mark.parametrize("size", [2.0**10, 2.0**26, 2.0**29])
def test_scores_of_any_size_are_exact(spark, size):
    rng = np.random.default_rng(4)
    x = np.floor(rng.standard_normal((300, 8)) * size)
    x[50:60] = x[50]
    x[60] = x[50] + 1
    x[::3] = np.floor(x[::3] / 2**20)  # small ones among them
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    got = {}
    for r in exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 20 == 10, k=12).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got == _best(rows, lambda i: i % 20 == 10, 12)


def test_scale_and_what_it_makes_infinite(spark):
    rows = [(1, [0.5, -0.25001]), (2, [1e308, 1.0]), (3, [1.0, 0.0]), (4, [0.00098, -0.001]), (None, [1.0, 1.0]), (5, [float("nan"), 1.0]), (1, [0.1, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in exact_top_k(df, F.col("vec_id") == 3, k=5, scale=1024).collect()]
    assert got == [(3, 1, 1, 512 * 1024), (3, 2, 1, 102 * 1024), (3, 3, 4, 1024)]


def test_parts_are_passed_over_without_loss():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 32)) * 400
    x = np.floor(centres[rng.integers(0, 20, 6000)] + rng.standard_normal((6000, 32)) * 20)
    ids = rng.permutation(10_000)[:6000]
    q = x[:50]
    got = {}
    for row, i, v in search_block(q, ids[:50], x, ids, 10):
        got.setdefault(row, []).append((i, v))
    for row in range(50):
        s = x @ q[row]
        want = [j for j in np.lexsort((ids, -s)) if j != row][:10]
        assert got[row] == [(int(ids[j]), int(s[j])) for j in want]


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [1.0])], [(0, [1.0, 2.0])]])
def test_top_k_defined_cases(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert exact_top_k(df, F.lit(True)).count() == 0


def test_each_width_is_searched_for_itself(spark):
    rows = [(k, [1.0, 0.1 * k, 0.0, 0.0]) for k in range(5)] + [(5, [1.0] * 5), (6, [1.0, 0.0]), (7, [1.0, 0.1]), (8, [0.0, 1.0]), (9, [3.0]), (10, [2.0]), (11, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_duplicates(df).collect()}
    assert got == {**dict.fromkeys(range(5), (4, 0)), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8), 9: (1, 9), 10: (1, 9), 11: (0, 11)}
    whole = [(k, [float(round(10 * x)) for x in v]) for k, v in rows] + [(12, [])]
    best = {}
    for r in exact_top_k(spark.createDataFrame(whole, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 5, 6, 12), k=2).orderBy("query_id", "rank").collect():
        best.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert best == {0: [(1, 100), (2, 100)], 6: [(7, 100), (8, 0)]}
