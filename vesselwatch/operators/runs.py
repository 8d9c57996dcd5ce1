"""Summaries of benchmark runs: best times, speed-ups, a fitted parallel share, averaged timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_runs(spark, pattern: str, dataset: str = r"[^/]*") -> DataFrame:
    """Samples (run, workers, chunk_size, elapsed_time_sec, total_rss_mb) of profile files in folders named ``<run>_w<N>_c<N>``."""
    samples = spark.read.option("header", True).csv(pattern).withColumn("file", F.col("_metadata.file_path"))
    part = lambda k: F.regexp_extract("file", rf"/({dataset})_w(\d+)_c(\d+)/[^/]*$", k)
    return samples.where(part(0) != "").select(
        part(1).alias("run"), part(2).cast("int").alias("workers"), part(3).cast("int").alias("chunk_size"),
        F.col("elapsed_time_sec").try_cast("double").alias("elapsed_time_sec"), F.col("total_rss_mb").try_cast("double").alias("total_rss_mb"),
    )


def run_totals(samples: DataFrame) -> DataFrame:
    """Peak memory and elapsed time of each run."""
    return samples.groupBy("run", "workers", "chunk_size").agg(
        F.max("elapsed_time_sec").alias("elapsed_time_sec"), F.max("total_rss_mb").alias("peak_memory_mb"), F.count("*").alias("samples")
    )


def speedups(totals: DataFrame) -> DataFrame:
    """Mean time of each setting and its speed-up over the fewest workers of its chunk size."""
    mean = totals.groupBy("chunk_size", "workers").agg(F.avg("elapsed_time_sec").alias("elapsed_time_sec"), F.max("peak_memory_mb").alias("peak_memory_mb"))
    base = F.first("elapsed_time_sec").over(Window.partitionBy("chunk_size").orderBy("workers"))
    return mean.withColumn("speedup", base / F.col("elapsed_time_sec"))


def parallel_share(speeds: DataFrame) -> DataFrame:
    """Amdahl's parallel share per chunk size by least squares on 1/speed-up = 1 - p (1 - 1/workers), within 0 and 1."""
    x, y = 1 - 1 / F.col("workers"), 1 - 1 / F.col("speedup")
    share = F.sum(x * y) / F.nullif(F.sum(x * x), F.lit(0.0))
    return speeds.groupBy("chunk_size").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("parallel_share"))


def mean_timeline(samples: DataFrame) -> DataFrame:
    """Mean and population deviation of memory at each sample number that all runs of a setting reach."""
    order = Window.partitionBy("run", "workers", "chunk_size").orderBy("elapsed_time_sec")
    numbered = samples.withColumn("sample_no", F.row_number().over(order))
    lengths = numbered.groupBy("workers", "chunk_size", "run").agg(F.max("sample_no").alias("n")).groupBy("workers", "chunk_size").agg(F.min("n").alias("least"))
    return (
        numbered.join(lengths, ["workers", "chunk_size"]).where("sample_no <= least")
        .groupBy("workers", "chunk_size", "sample_no").agg(F.avg("total_rss_mb").alias("mean_mb"), F.stddev_pop("total_rss_mb").alias("deviation_mb"))
    )
