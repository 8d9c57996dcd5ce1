"""Exact top-k search with multi-resolution segment statistics.

A vector is cut into segments; a segment's mean and deviation bound distances from below:
|q - x|^2 >= sum over segments of length * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2), hence inner products
from above: q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= sum of length * (mean_q mean_x + dev_q dev_x).
The bounds tighten from coarse to fine segments. Rows whose bound falls below a query's k-th best exact
score so far are dropped; the survivors of the finest level are scored exactly. A whole block of rows is
passed over if the ranges of its statistics allow no score that high.

Each query brings a first limit: its k-th best score among a bounded sample of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vesselwatch.llm.common import bounded_batches

#: Segments of the levels, coarse to fine (as far as the width allows).
LEVELS = (2, 4, 8, 16)
#: Candidates and queries of one task, at most, and bytes of its candidates, about.
ROWS, QUERIES, BYTES = 32_768, 4096, 1 << 25
#: Candidates are cut into so many blocks at least, to keep all executors busy on small tables.
LEAST_BLOCKS = 24
#: Rows of a block that is passed over as a whole.
LEAF = 1024
#: Rows that give the first limits, at most, and bytes of them, about.
SAMPLE, SAMPLE_BYTES = 2048, 1 << 24
#: Slack for the rounding of bounds: far below the distance of two integer scores, and a share of the largest score possible.
SLACK, SHARE = 0.25, 1e-12
#: Products of norms up to here have scores that doubles hold exactly.
EXACT = 2.0**53


def summaries(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that the bound is a plain inner product."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        part, root = x[:, lo:hi], np.sqrt(hi - lo)
        out += [part.mean(axis=1) * root, part.std(axis=1) * root]
    return np.stack(out, axis=1)


def leaves(features: np.ndarray, rows: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """``rows`` halved at the median of the widest statistic until a part has at most ``size``."""
    if len(rows) <= size:
        return [rows]
    widest = int(np.ptp(features[rows], axis=0).argmax())
    order = rows[np.argsort(features[rows, widest], kind="stable")]
    return leaves(features, order[: len(order) // 2], size) + leaves(features, order[len(order) // 2 :], size)


def search_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, limit: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(row of q, id of x, score) of the k best of ``x`` for each query that may be among its best; ``limit``: scores below don't count."""
    levels = [(summaries(q, s), summaries(x, s)) for s in LEVELS if s <= x.shape[1]] or [(summaries(q, 1), summaries(x, 1))]
    norm_q, norm_x = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    slack = SLACK + SHARE * norm_q * norm_x.max()
    limit = np.full(len(q), -np.inf) if limit is None else limit.copy()
    scores, ids = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    large: dict[int, list[tuple[int, int]]] = {}  # by query: exact scores that doubles don't hold, and ids
    fine_q, fine_x = levels[-1]
    parts = leaves(fine_x, np.arange(len(x)))
    low, high = (np.array([f(fine_x[p], axis=0) for p in parts]) for f in (np.min, np.max))
    top = np.maximum(fine_q, 0) @ high.T + np.minimum(fine_q, 0) @ low.T  # of each query in each part
    for p in np.argsort(-top.mean(axis=0), kind="stable"):
        part = parts[p]
        asked = np.flatnonzero(top[:, p] >= limit - slack)
        for at in range(0, len(asked), 512):
            rows = asked[at : at + 512]
            least = (limit - slack)[rows][:, None]
            open_ = q_ids[rows][:, None] != x_ids[part]
            for level_q, level_x in levels:
                open_ = _still(open_, level_q[rows], level_x[part], least)
            a, b = open_.nonzero()
            if len(a):
                exact = _products(open_, q[rows], x[part])
                for n in np.flatnonzero(norm_q[rows[a]] * norm_x[part[b]] >= EXACT):
                    score = sum(int(u) * int(v) for u, v in zip(q[rows[a[n]]], x[part[b[n]]], strict=True))
                    exact[n] = float(score)
                    large.setdefault(int(rows[a[n]]), []).append((score, int(x_ids[part[b[n]]])))
                a = np.concatenate([a, np.repeat(np.arange(len(rows)), k)])
                s, i = np.concatenate([exact, scores[rows].ravel()]), np.concatenate([x_ids[part[b]], ids[rows].ravel()])
                order = np.lexsort((i, -s, a))
                best = order[np.searchsorted(a[order], np.arange(len(rows)))[:, None] + np.arange(k)]
                scores[rows], ids[rows] = s[best], i[best]
                limit[rows] = np.maximum(limit[rows], scores[rows, k - 1])
    out = []
    for row in range(len(q)):
        found = [(int(v), int(i)) for v, i in zip(scores[row], ids[row], strict=True) if v > -np.inf]
        if row in large:  # all of these are kept by their exact score
            known = {i for _, i in large[row]}
            found = sorted([f for f in found if f[1] not in known] + large[row], key=lambda f: (-f[0], f[1]))[:k]
        out += [(row, i, v) for v, i in found]
    return out


def _still(open_: np.ndarray, fq: np.ndarray, fx: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Pairs whose bound at this level reaches the limit; of few open pairs only their own bounds are computed."""
    if np.count_nonzero(open_) > open_.size // 16:
        return open_ & (fq @ fx.T >= least)
    a, b = open_.nonzero()
    keep = np.einsum("ij,ij->i", fq[a], fx[b]) >= least[a, 0]
    out = np.zeros_like(open_)
    out[a[keep], b[keep]] = True
    return out


def _products(open_: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b = open_.nonzero()
    return (q @ x.T)[a, b] if len(a) > open_.size // 16 else np.einsum("ij,ij->i", q[a], x[b])


def _rows(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _limits(sample, k: int):
    """The k-th best score of each query among the sample, minus infinity if that has fewer rows of its width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limit = np.full(len(batch), -np.inf)
            widths, ids = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            for w in np.unique(widths):
                others_ids, others = sample.value.get(int(w), (np.empty(0, np.int64), np.empty((0, int(w)))))
                rows = np.flatnonzero(widths == w)
                if len(others) >= k:
                    q = _rows(batch.column(1).take(pa.array(rows)), int(w))
                    s = np.where(ids[rows][:, None] != others_ids, q @ others.T, -np.inf)
                    limit[rows] = np.partition(s, -k, axis=1)[:, -k]
            yield pa.record_batch([*batch.columns, pa.array(limit)], names=["id", "vector", "width", "limit"])

    return run


def _task(k: int):
    def run(table: pa.Table) -> pa.Table:
        limit, ids = table.column("limit").to_numpy(zero_copy_only=False), table.column("id").to_numpy()
        x = _rows(table.column("vector"), table.column("width")[0].as_py())
        asks = ~np.isnan(limit)
        q, there = np.flatnonzero(asks), np.flatnonzero(~asks)
        found = search_block(x[q], ids[q], x[there], ids[there], k, limit[q]) if len(q) and len(there) else []
        least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        return pa.table({
            "query_id": pa.array([int(ids[q[a]]) for a, _, _ in found], pa.int64()), "vec_id": pa.array([i for _, i, _ in found], pa.int64()),
            "score": pa.array([min(max(v, least), most) for _, _, v in found], pa.int64()),
        })

    return run


def _scaled(scale: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            if scale is not None:
                with np.errstate(over="ignore"):
                    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False))
                vectors = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(pa.compute.list_value_length(vectors).to_numpy()))).astype(np.int32)), pa.array(flat))
            yield pa.record_batch([batch.column(0), vectors, batch.column(2)], names=["id", "vector", "asks"])

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query, ties to smaller ids.

    ``vectors`` holds integer components (as doubles), or ``scale`` makes them so: each becomes floor(scale * x).
    Scores are exact whatever their size: beyond 2^53 they are computed as integers; beyond 64 bits the result
    shows the largest (smallest) long and ties there go to smaller ids. ``is_query`` says which rows are queries. Every row
    but those of the query's own id is a candidate.

    Queries and candidates meet in blocks, each candidate once for ``QUERIES`` queries.

    Defined cases: rows with a null id or vector, an empty vector, or null or non-finite components (also after scaling) take no
    part. Candidates of a query are the vectors of its width, whatever widths others have. Repeated ids are candidates of their own; a repeated
    query is answered once. A query with fewer than k candidates gets all. Empty tables give an empty
    result; other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    given = given.where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)))
    if scale is not None:
        given = given.mapInArrow(_scaled(scale), "id long, vector array<double>, asks boolean").where(finite)
    rows = given.withColumn("width", F.size("vector")).where("width > 0")
    facts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.coalesce(F.max("width"), F.lit(1)).alias("w")).first()
    n, q, widest = facts["n"], facts["q"], facts["w"]
    x_blocks = max(LEAST_BLOCKS, -(-n // max(1, min(ROWS, BYTES // (8 * widest)))))
    q_blocks = max(1, -(-q // max(1, min(QUERIES, BYTES // (8 * widest)))))
    picked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    few = max(k, min(SAMPLE, SAMPLE_BYTES // (8 * widest)))
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(few).select("id", "vector", "width").toArrow().to_pylist():  # at most so many rows
        ids, x = picked.setdefault(r["width"], ([], []))
        ids.append(r["id"])
        x.append(r["vector"])
    sample = spark.sparkContext.broadcast({w: (np.array(ids), np.array(x)) for w, (ids, x) in picked.items()})
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    lot = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    asked = rows.where("asks").dropDuplicates(["id"]).select("id", "vector", "width").mapInArrow(_limits(sample, k), "id long, vector array<double>, width int, limit double")
    asked = asked.withColumn("qb", lot(q_blocks, 1)).select("*", every(x_blocks).alias("xb"))
    there = rows.select("id", "vector", "width", F.lit(float("nan")).alias("limit"), lot(x_blocks, 2).alias("xb")).select("*", every(q_blocks).alias("qb"))
    best = asked.unionByName(there).groupBy("xb", "qb", "width").applyInArrow(_task(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
