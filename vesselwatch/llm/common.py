"""Helpers shared by the training-data operators: tables, shared scratch space, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselwatch.session import discard, ship_package, stored

#: Bytes of one Arrow batch handed to Python; bounds a worker's memory whatever the length of texts.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 10_000) -> None:
    """Get a session ready for Python tasks.

    Arrow batches are limited by bytes (and rows), so that long texts don't pile up in a Python worker.
    The package is shipped once per application, as executors need not have it installed.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there."""
    return stored(df, f"llm-{name}")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names made of ``names`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows: the check that precedes every explicit broadcast."""
    return df.limit(rows + 1).count() <= rows


def semi_join(big: DataFrame, keys: DataFrame, on: str, rows: int = 1_000_000) -> DataFrame:
    """Rows of ``big`` whose ``on`` occurs in ``keys`` (distinct longs).

    ``keys`` is broadcast only if it has at most ``rows`` rows (16 MB); beyond that both sides shuffle.
    """
    if small_enough(keys, rows):
        keys = F.broadcast(keys)
    return big.join(keys, on, "left_semi")


def anti_join(big: DataFrame, keys: DataFrame, on: str, rows: int = 1_000_000) -> DataFrame:
    """Rows of ``big`` whose ``on`` doesn't occur in ``keys``; nulls stay. Broadcast as in ``semi_join``."""
    if small_enough(keys, rows):
        keys = F.broadcast(keys)
    return big.join(keys, on, "left_anti")


def lookup_join(big: DataFrame, small: DataFrame, on: str, row: Column, rows: int = 100_000, salts: int = 16) -> DataFrame:
    """Left join to a table with one row for each ``on``.

    It is broadcast if it has at most ``rows`` rows; beyond that both sides shuffle, the rows of a key dealt to
    ``salts`` partitions by ``row``, a number that differs among them.
    """
    if small_enough(small, rows):
        return big.join(F.broadcast(small), on, "left")
    (salt,) = free_names(big, "salt")
    every = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn(salt, F.pmod(row, F.lit(salts)).cast("int")).join(every, [on, salt], "left").drop(salt)


def group_join(rows: DataFrame, groups: DataFrame, on: str, size: str, hot: int = 100_000, most: int = 100_000, nulls: bool = True) -> DataFrame:
    """Left join of ``rows`` to ``groups``, one row for each ``on``, whose ``size`` says how many rows have that key.

    Rows of groups over ``hot`` don't meet in one task: these few groups are broadcast, if at most ``most``. Nor do rows
    with a null key, which never match (``nulls``: whether there may be any). ``rows`` is read once for each way.
    """
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in groups.schema if f.name not in (on, size)]
    large = groups.where(F.col(size) > hot).drop(size)
    found = [rows.where(F.col(on).isNull()).select("*", *empty)] if nulls else []
    keyed, groups = rows.where(F.col(on).isNotNull()) if nulls else rows, groups.drop(size)
    if not large.isEmpty() and small_enough(large, most):
        found.append(keyed.join(F.broadcast(large), on))
        keyed = keyed.join(F.broadcast(large.select(on)), on, "left_anti")
    return reduce(DataFrame.unionByName, found, keyed.join(groups, on, "left"))


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", hub: int = 1_000_000) -> DataFrame:
    """(node, component): the smallest node that each linked node can reach.

    Alternates large-star and small-star steps. Every step is a grouped minimum (combined before the
    shuffle) and an equi-join. The edges of a node with over ``hub`` of them are joined by broadcast, so that the centre of a
    huge star is never gathered in one task.
    Nodes without an edge (or only with an edge to themselves) are not returned; nulls are ignored.
    """
    now = materialize(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    seen = _fingerprint(now)
    while seen[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("n"))
        # fewer edges than a hub has: there is none to look for
        meet = (lambda rows, least: group_join(rows, least, "u", "n", hub)) if seen[0] > hub else (lambda rows, least: rows.join(least.drop("n"), "u"))
        large = (
            meet(both.where("v > u"), low)
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            meet(large, low).where("v > m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        before, now = now, materialize(small, "edges")
        discard(before)
        last, seen = seen, _fingerprint(now)
        if last == seen:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
