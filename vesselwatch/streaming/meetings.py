"""Meetings (B) over a stream of candidate points, by the batch rules on the part of time that is still open.

Each micro-batch adds its points to a table and derives the sessions of the time since the earliest session
still open. A session is closed once a later occupied bucket lies beyond the continuation gap; it is written then. Only
buckets before the newest one count, as the newest may still get points. On points in the order of their buckets
the events equal the batch's, however the stream is cut.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vesselwatch.config import Detection
from vesselwatch.operators.meetings import sessions_of

_DAY = 86_400


def _known(spark: SparkSession, table: str, before: int) -> tuple[int | None, int | None]:
    """(bucket that the open time begins with, last bucket that was processed) after the micro-batches before this one."""
    try:
        rows = spark.read.parquet(f"{table}/progress").where(F.col("batch") < before)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing was written yet
            return None, None
        raise
    last = rows.agg(F.max_by(F.struct("since", "upto"), "batch").alias("last")).first()["last"]
    return (last["since"], last["upto"]) if last else (None, None)


def _held(spark: SparkSession, table: str, since: int | None, number: int) -> DataFrame:
    held = spark.read.parquet(f"{table}/points").where(F.col("batch") <= number)
    return held if since is None else held.where((F.col("day") >= since // _DAY) & (F.col("bucket") >= since))


def _sessions(points: DataFrame, config: Detection, exact_grid: bool, open_after: int | None = None) -> DataFrame:
    return sessions_of(points.select("mmsi", "bucket", "latitude", "longitude", "seq"), config, exact_grid, least_h=config.meeting_h, open_after=open_after)


def _write(df: DataFrame, table: str, name: str, number: int) -> None:
    """A micro-batch writes its own folder, replaced when it is repeated."""
    df.write.mode("overwrite").parquet(f"{table}/{name}/batch={number}")


def _process(batch: DataFrame, number: int, table: str, config: Detection, exact_grid: bool) -> None:
    spark = batch.sparkSession
    since, upto = _known(spark, table, number)
    late = F.lit(False) if upto is None else F.col("bucket") <= upto
    _write(batch.where(late), table, "late", number)
    fresh = batch.where(~late).select("mmsi", "bucket", "latitude", "longitude", "seq")
    fresh = fresh.withColumn("day", F.floor(F.col("bucket") / _DAY)).withColumn("batch", F.lit(number).cast("long"))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{table}/points")
    held = _held(spark, table, since, number)
    newest = [r["bucket"] for r in held.select("bucket").distinct().orderBy(F.desc("bucket")).limit(2).collect()]
    if len(newest) == 2:
        gap, before = config.continuation_s, upto
        upto = newest[1]
        # long sessions that are closed, and since when others are open: far fewer than all sessions. The latter is observed while the former are written, once
        closed, seen = F.col("mmsi_b").isNotNull(), Observation(f"open-{uuid4().hex}")
        sessions = _sessions(held.where(F.col("bucket") <= upto), config, exact_grid, upto - gap - 1).observe(seen, F.min(F.when(~closed, F.col("start_epoch"))).alias("since"))
        told = F.lit(False) if before is None else F.lit(before) - F.col("end_epoch") > gap
        _write(sessions.where(closed & ~told), table, "events", number)
        since = newest[0] if (earliest := seen.get["since"]) is None else earliest
    _write(spark.createDataFrame([(since, upto)], "since long, upto long"), table, "progress", number)


def rolling_meetings(points: DataFrame, table: str, checkpoint: str, config: Detection | None = None, exact_grid: bool = False) -> object:
    """Runs over what there is of ``points`` (streaming: mmsi, bucket, latitude, longitude, seq).

    Below ``table`` it keeps ``points`` (by day), ``events`` (closed meetings), ``late`` (points of buckets that were already
    processed) and ``progress``. Repeated runs go on where the last one ended.
    """
    config = config or Detection()
    query = points.writeStream.foreachBatch(lambda batch, number: _process(batch, number, table, config, exact_grid))
    query = query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def close_meetings(spark: SparkSession, table: str, config: Detection | None = None, exact_grid: bool = False) -> None:
    """The end of a stream: writes the meetings still open, the newest bucket included."""
    config, last = config or Detection(), (1 << 62)
    since, upto = _known(spark, table, last)
    sessions = _sessions(_held(spark, table, since, last), config, exact_grid)
    told = F.lit(False) if upto is None else F.lit(upto) - F.col("end_epoch") > config.continuation_s
    _write(sessions.where(~told), table, "events", last)
