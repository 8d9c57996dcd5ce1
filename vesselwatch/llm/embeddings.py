"""Near-duplicate vectors by an inverted multi-index.

Each half of a unit vector has its own codebook; the pairs of centroids form a grid of cells. A vector
lives in the cell of its two nearest centroids and looks into the cells that a multi-sequence traversal
visits first (nearest sum of the two centroid distances). How many it visits is calibrated once: bounded
sample vectors are moved to exactly the least allowed cosine, and the number is the one at which the
target share of these hardest partners is met. All candidates are verified in double precision.

A vector's visits are one number, its reach: the distance sum of the last cell it visits. Distances for the grid are
taken between integer vectors, so they are the same wherever they are computed.

Work is dealt by groups of neighbouring strips of the grid (first centroids) with about ``BLOCK`` residents: a vector is
sent to its own group and once to each other one that its visits touch. Groups with more are cut into blocks of rows,
so that no task gets more than ``BLOCK`` residents and ``VISITORS`` visitors however many vectors crowd one
cell. A task returns sums and one edge for each vector, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselwatch.llm.common import bounded_batches, connected_components, group_join, materialize

#: Rows that the codebooks and the number of visits are fitted on: eight for each centroid, within these bounds.
LEAST_SAMPLE, SAMPLE = 4096, 65_536
#: Vectors of a cell, about.
CELL = 32
#: Share of the hardest partners (those at the least allowed cosine) that the visits must meet. A link is found
#: from either side, so two such shares stand between it and being missed. 1: every cell is visited, nothing is missed.
TARGET = 0.95
#: Residents and visitors of a block of vectors of up to 128 components; fewer of wider ones.
BLOCK, VISITORS = 4096, 16_384
#: Vectors for the grid are rounded to this part.
GRID = 4096
FOUND = "cls long, links long, label long"


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[at : at + 1024], centroids).argmin(axis=1) for at in range(0, len(x), 1024)]) if len(x) else np.empty(0, int)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centroids of ``x``; k-means on fewer distinct rows than k repeats some."""
    rng = np.random.Generator(np.random.PCG64(7))
    centroids = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        nearest = _nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=k)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def _chain(centroids: np.ndarray) -> list[int]:
    """All centroids, each followed by the nearest one left."""
    left, order = set(range(1, len(centroids))), [0]
    while left:
        rest = np.fromiter(left, int)
        order.append(int(rest[_distances(centroids[order[-1:]], centroids[rest])[0].argmin()]))
        left.remove(order[-1])
    return order


class MultiIndex:
    """Two codebooks and the number of cells to visit. ``x`` is always unit rows in double precision."""

    def __init__(self, sample: np.ndarray, k: int, cosine: float, target: float = TARGET):
        half = sample.shape[1] // 2
        self.k, self.half = k, half
        self.first, self.second = np.rint(GRID * codebook(sample[:, :half], k)), np.rint(GRID * codebook(sample[:, half:], k))
        rng = np.random.Generator(np.random.PCG64(11))
        base = sample[:1024]
        away = rng.standard_normal(base.shape)
        away -= (away * base).sum(axis=1, keepdims=True) * base
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
        partner = cosine * base + math.sqrt(1 - cosine * cosine) * away
        self.visits = k * k if target >= 1 else int(np.quantile(self._ranks(base, partner), target)) + 1

    def _ranks(self, x: np.ndarray, partner: np.ndarray) -> list[int]:
        """How many cells the traversal from ``x`` visits before the partner's: counted in the sorted distances of both halves."""
        out = []
        i, j = _nearest(self.grid(partner)[:, : self.half], self.first), _nearest(self.grid(partner)[:, self.half :], self.second)
        for at in range(0, len(x), 64):
            for a, b, u, v in zip(*self.to_centroids(x[at : at + 64]), i[at : at + 64], j[at : at + 64], strict=True):
                out.append(int(np.searchsorted(np.sort(b), a[u] + b[v] - a, "left").sum()))
        return out

    @staticmethod
    def grid(x: np.ndarray) -> np.ndarray:
        return np.rint(GRID * x)

    def to_centroids(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to their centroids: whole numbers, exact in any order of summing."""
        g = self.grid(x)
        return _distances(g[:, : self.half], self.first), _distances(g[:, self.half :], self.second)

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.to_centroids(x)
        return a.argmin(axis=1) * self.k + b.argmin(axis=1)

    def reach(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The distance sum of the last cell visited.

        Multi-sequence order: only centroid pairs whose ranks multiply to at most the number of visits can be among
        the first, since every pair of better ranks comes before.
        """
        if self.visits >= self.k * self.k:
            return a.max(axis=1) + b.max(axis=1)
        sa, sb = np.sort(a, axis=1), np.sort(b, axis=1)
        ranks = np.arange(1, self.k + 1)
        upto = np.minimum(self.visits // ranks, self.k)
        i = np.repeat(np.arange(self.k), upto)
        j = np.arange(len(i)) - np.repeat(np.cumsum(upto) - upto, upto)
        out = np.empty(len(a))
        step = max(1, (1 << 21) // len(i))
        for at in range(0, len(a), step):
            total = sa[at : at + step, i] + sb[at : at + step, j]
            out[at : at + step] = np.partition(total, self.visits - 1, axis=1)[:, self.visits - 1]
        return out


def unit_rows(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of an Arrow list column (all of ``width`` finite numbers) as unit rows in double precision."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return x / _norms(x)


def _norms(x: np.ndarray) -> np.ndarray:
    """Row norms, scaled first so that very large or small components neither overflow nor vanish."""
    top = np.abs(x).max(axis=1, keepdims=True)
    return top * np.sqrt(((x / top) ** 2).sum(axis=1, keepdims=True))


def _strips(index, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                g = MultiIndex.grid(unit_rows(batch.column(0).slice(at, 1024), width))
                yield pa.record_batch([pa.array(_nearest(g[:, : index.value.half], index.value.first).astype(np.int32))], names=["strip"])

    return run


def _placed(index, groups: np.ndarray, width: int):
    """For each class: its cell, its reach, its group and the groups that its visits touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, count = index.value, int(groups.max()) + 1
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                a, b = net.to_centroids(unit_rows(part.column(1), width))
                reach, i = net.reach(a, b), a.argmin(axis=1)
                row, strip = (a + b.min(axis=1, keepdims=True) <= reach[:, None]).nonzero()
                touched = np.unique(row * count + groups[strip])
                sizes = np.bincount(touched // count, minlength=len(part))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array((touched % count).astype(np.int32)))
                cell = i * net.k + b.argmin(axis=1)
                yield pa.record_batch(
                    [part.column(0), part.column(1), part.column(2), pa.array(cell.astype(np.int64)), pa.array(reach.astype(np.int64)), pa.array(groups[i].astype(np.int32)), lists],
                    names=["cls", "vector", "weight", "cell", "reach", "home", "touched"],
                )

    return run


def _block(index, width: int, cosine: float):
    """Links of one block of residents with one block of visitors of the same group."""

    def run(table: pa.Table) -> pa.Table:
        net = index.value
        cls, weight, cell, reach = (table.column(c).to_numpy() for c in ("cls", "weight", "cell", "reach"))
        resident = table.column("resident").to_numpy()
        x = unit_rows(table.column("vector").combine_chunks(), width)
        home, away = np.flatnonzero(resident), np.flatnonzero(~resident)
        links, near_home, near_away = np.zeros(len(cls), np.int64), [], []
        if len(home) and len(away):
            order = home[np.argsort(cell[home], kind="stable")]
            cuts = np.flatnonzero(np.diff(cell[order])) + 1
            g = net.grid(x)
            to_second = _distances(g[away, net.half :], net.second)
            strip, to_strip = -1, None
            for there in np.split(order, cuts):
                i, j = divmod(int(cell[there[0]]), net.k)
                if i != strip:  # cells come strip by strip
                    strip, to_strip = i, _distances(g[away, : net.half], net.first[i : i + 1])[:, 0]
                come = away[to_strip + to_second[:, j] <= reach[away]]
                for at in range(0, len(come), 2048):
                    some = come[at : at + 2048]
                    p, h = ((x[some] @ x[there].T >= cosine) & (cls[some][:, None] != cls[there])).nonzero()
                    if len(p):
                        u, v = some[p], there[h]
                        np.add.at(links, u, weight[v])
                        unseen = ~_looks_into(net, g, reach, v, cell[u])
                        np.add.at(links, v[unseen], weight[u[unseen]])  # v doesn't look into u's cell: nobody else counts it
                        near_away.append(u)
                        near_home.append(v)
        if not near_home:
            return pa.table({"cls": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "label": pa.array([], pa.int64())})
        u, v = np.concatenate(near_away), np.concatenate(near_home)
        _, who = np.unique(cls, return_inverse=True)  # a class may be both resident and visitor
        label = np.full(len(cls), np.iinfo(np.int64).max)
        np.minimum.at(label, who, cls)
        while True:
            low = np.minimum(label[who[u]], label[who[v]])
            before = label.copy()
            np.minimum.at(label, who[u], low)
            np.minimum.at(label, who[v], low)
            if (before == label).all():
                break
        rows = np.unique(np.concatenate([u, v]))
        return pa.table({"cls": cls[rows], "links": links[rows], "label": label[who[rows]]})

    return run


def _looks_into(net: MultiIndex, g: np.ndarray, reach: np.ndarray, v: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Whether each of the rows ``v`` visits the cell beside it; equal pairs are computed once."""
    pairs, back = np.unique(np.stack([v, cells]), axis=1, return_inverse=True)
    out = np.empty(pairs.shape[1], bool)
    for at in range(0, len(out), 16384):
        row, cell = pairs[:, at : at + 16384]
        i, j = cell // net.k, cell % net.k
        away = ((g[row, : net.half] - net.first[i]) ** 2).sum(axis=1) + ((g[row, net.half :] - net.second[j]) ** 2).sum(axis=1)
        out[at : at + 16384] = away <= reach[row]
    return out[back.reshape(-1)]


def _whole(cosine: float):
    """Links of all classes of one width, each pair compared."""

    def run(table: pa.Table) -> pa.Table:
        cls, weight = (table.column(c).to_numpy() for c in ("cls", "weight"))
        x = unit_rows(table.column("vector").combine_chunks(), table.column("width")[0].as_py())
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        label = cls.copy()
        while True:
            low = np.minimum(label, np.where(near, label, np.iinfo(np.int64).max).min(axis=1))
            if (low == label).all():
                break
            label = low
        rows = near.any(axis=1)
        return pa.table({"cls": cls[rows], "links": (near @ weight)[rows], "label": label[rows]})

    return run


#: Vectors of a width that are compared pair by pair in one task, at most.
FEW = 1024


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, target: float = TARGET, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Two rows are linked if the cosine of their vectors is at least ``cosine`` (double precision) and the
    index finds them (always, if ``target`` is 1). Equal vectors are one class: its members are linked with each other and share
    the class's links. ``component_id`` is the smallest id reachable over links.

    Defined cases: a vector that is null, empty, zero, or holds null or non-finite components links with
    nothing. Vectors of different widths aren't linked; each width is searched for itself: the most frequent one
    and all with more than ``FEW`` classes by an index, the others pair by pair. Repeated rows (also of one id)
    count as vectors of their own for ``n_links``. Rows with null ids are returned as strangers, kept, with
    a null component. An empty table gives an empty result. Other columns are ignored.

    The codebooks and the number of visits of a width are fitted on at most ``sample`` vectors (those with
    the smallest hashes); all vectors are indexed.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    element = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    good = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(F.coalesce(finite, F.lit(False)))
    classes = materialize(good.groupBy("vector").agg(F.min("id").alias("cls"), F.count("*").alias("weight")).withColumn("width", F.size("vector")), "vectors")
    sizes = {r["width"]: r["n"] for r in classes.groupBy("width").agg(F.count("*").alias("n")).collect()}
    if sizes:
        first = max(sizes, key=lambda w: (sizes[w], w))
        indexed = [w for w, n in sizes.items() if w == first or n > FEW]
        found = [_indexed_links(classes.where(F.col("width") == w), sizes[w], w, element, cosine, target, sample) for w in indexed]
        if len(indexed) < len(sizes):
            found.append(classes.where(~F.col("width").isin(indexed)).groupBy("width").applyInArrow(_whole(cosine), FOUND))
        together = found[0]
        for more in found[1:]:
            together = together.unionByName(more)
        if len(found) > 1:
            together = materialize(together, "found")
        labels = connected_components(together, "cls", "label")
        links = together.groupBy("cls").agg(F.sum("links").alias("links"))
        classes = classes.join(links, "cls", "left").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    else:
        classes = classes.withColumn("links", F.lit(0).cast("long")).withColumn("component", F.lit(None).cast("long"))
    classes = classes.select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "cls").alias("root"), "weight"
    )
    out = group_join(rows, materialize(classes, "classes"), "vector", "weight")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _indexed_links(classes: DataFrame, n: int, width: int, element: str, cosine: float, target: float, sample: int) -> DataFrame:
    """(cls, links, label) of the ``n`` classes, all of one width, by the multi-index."""
    k = max(4, math.ceil(math.sqrt(n / CELL)))
    rows = min(sample, max(LEAST_SAMPLE, 8 * k), max(256, (1 << 26) // (8 * width)))
    picked = classes.orderBy(F.xxhash64("cls"), "cls").limit(rows).select("vector").toArrow().column("vector").combine_chunks()
    k = min(k, max(4, len(picked) // 4))  # a centroid of fewer than four vectors says nothing
    fitted = MultiIndex(unit_rows(picked, width), k, cosine, target)
    index = classes.sparkSession.sparkContext.broadcast(fitted)  # 2 k vectors of half the width, k bounded by the sample
    block, most = (max(64, min(b, b * 128 // width)) for b in (BLOCK, VISITORS))

    # a row for each strip, at most k; neighbouring ones are put together until they fill a block
    residents = {r["strip"]: r["n"] for r in classes.select("vector").mapInArrow(_strips(index, width), "strip int").groupBy("strip").agg(F.count("*").alias("n")).collect()}
    groups, held, group = np.zeros(k, np.int64), [0], 0
    for strip in _chain(fitted.first):
        size = residents.get(strip, 0)
        if held[group] and held[group] + size > block:
            group += 1
            held.append(0)
        groups[strip] = group
        held[group] += size
    placed = materialize(
        classes.select("cls", "vector", "weight").mapInArrow(
            _placed(index, groups, width), f"cls long, vector array<{element}>, weight long, cell long, reach long, home int, touched array<int>"
        ),
        "cells",
    )
    visitors = {r["g"]: r["n"] for r in placed.select(F.explode("touched").alias("g")).groupBy("g").agg(F.count("*").alias("n")).collect()}
    cut = classes.sparkSession.createDataFrame(
        [(g, max(1, -(-n // block)), max(1, -(-visitors.get(g, 0) // most))) for g, n in enumerate(held)], "g int, hn long, vn long"
    )  # a row for each group, at most k
    lot = F.pmod(F.xxhash64("cls"), F.lit(1 << 30))
    columns = ["cls", "vector", "weight", "cell", "reach"]
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    at_home = placed.withColumn("g", F.col("home")).join(F.broadcast(cut), "g").select(*columns, F.lit(True).alias("resident"), "g", (lot % F.col("hn")).alias("hb"), every("vn").alias("vb"))
    away = placed.withColumn("g", F.explode("touched")).join(F.broadcast(cut), "g").select(*columns, F.lit(False).alias("resident"), "g", every("hn").alias("hb"), (lot % F.col("vn")).alias("vb"))
    return materialize(at_home.unionByName(away).groupBy("g", "hb", "vb").applyInArrow(_block(index, width, cosine), FOUND), "found")
