"""Meetings (B) over a stream with state for each pair of vessels and event-time timers.

Points of neighbouring cells meet in a stream-stream join, whose state ends with the watermark. What it finds goes to
the pair's own state: the closest observation of each bucket that isn't complete yet, and the session that is open. When the watermark
passes a bucket, its observation goes on with the session or begins a new one; when it passes the session's end by the
continuation gap, the session is closed, its meeting is returned and the pair's state is gone. Points that come late,
but not behind the watermark, enter their bucket as if they had been on time. The result is that of the batch with
``strict_gap``, however the stream is cut and ordered within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vesselwatch.config import Detection
from vesselwatch.functions.geo import haversine_km
from vesselwatch.operators.meetings import cell_sides
from vesselwatch.session import ship_package

POINTS = "mmsi long, bucket long, latitude double, longitude double, seq long"
_PLACES = ["lat_a", "lon_a", "lat_b", "lon_b"]
MEETINGS = (
    "mmsi_a long, mmsi_b long, start_epoch long, end_epoch long, duration_hours double, observations long, min_distance_km double, avg_distance_km double, "
    + ", ".join(f"{side}_{c} double" for side in ("start", "end") for c in _PLACES)
)
_NAMES = [c.split()[0] for c in MEETINGS.split(", ")]
_OBSERVATION = "km double, seq_a long, seq_b long, " + ", ".join(f"{c} double" for c in _PLACES)
_SESSION = "since long, upto long, observations long, least_km double, sum_km double, " + ", ".join(f"{side}_{c} double" for side in ("start", "end") for c in _PLACES)
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: No vessel: a point that only moves the watermark on.
_NOBODY = -1


class PairMeetings(StatefulProcessor):
    """``bucket_s``: a bucket is complete when the watermark passes its end, which is its points' event time."""

    def __init__(self, continuation_s: int, least_h: float, bucket_s: int):
        self.gap, self.least_h, self.bucket_s = continuation_s, least_h, bucket_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", f"bucket long, {_OBSERVATION}")
        self.open = handle.getValueState("open", _SESSION)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """All observations are added at once, with one timer for the first of their buckets: each call to the state store takes about a millisecond."""
        best: dict[int, tuple] = {}
        for frame in rows:
            for bucket, *seen in frame[["bucket", "km", "seq_a", "seq_b", *_PLACES]].itertuples(index=False):
                bucket, seen = int(bucket), (float(seen[0]), int(seen[1]), int(seen[2]), *map(float, seen[3:]))
                best[bucket] = min(best.get(bucket, seen), seen)
        if best:
            self.pending.appendList([(bucket, *seen) for bucket, seen in best.items()])
            self.handle.registerTimer(self._due(min(best)))
        return iter(())

    def _due(self, bucket: int) -> int:
        return (bucket + self.bucket_s) * 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000 - self.bucket_s
        session = tuple(self.open.get()) if self.open.exists() else None
        closed = []
        best: dict[int, tuple] = {}
        for bucket, *seen in self.pending.get():
            best[bucket] = min(best.get(bucket, tuple(seen)), tuple(seen))
        waiting = {bucket: seen for bucket, seen in best.items() if bucket > passed}
        if len(waiting) < len(best):
            if waiting:
                self.pending.put([(bucket, *seen) for bucket, seen in waiting.items()])
                self.handle.registerTimer(self._due(min(waiting)))
            else:
                self.pending.clear()
        for bucket in sorted(best.keys() - waiting.keys()):
            km, _, _, *at = best[bucket]
            if session is not None and bucket - session[1] <= self.gap:
                session = (session[0], bucket, session[2] + 1, min(session[3], km), session[4] + km, *session[5:9], *at)
            else:
                closed += [session] if session is not None else []
                session = (bucket, bucket, 1, km, km, *at, *at)
        if session is not None and passed - session[1] > self.gap:
            closed.append(session)
            session = None
        if session is None:
            self.open.clear()
        else:
            self.open.update(session)
            self.handle.registerTimer((session[1] + self.gap + 1 + self.bucket_s) * 1000)
        told = [self._row(key, s) for s in closed if (s[1] - s[0]) / 3600 >= self.least_h]
        return iter([pd.DataFrame(told, columns=_NAMES)] if told else ())

    def _row(self, key, s: tuple) -> tuple:
        return (*key, s[0], s[1], (s[1] - s[0]) / 3600, s[2], s[3], s[4] / s[2], *s[5:])

    def close(self) -> None:
        pass


def stream_meetings(points: DataFrame, config: Detection | None = None, delay: str = "1 hour", exact_grid: bool = False) -> DataFrame:
    """Closed meetings of a streaming DataFrame of candidate points (``POINTS``); points over ``delay`` late are dropped and counted by Spark.

    The session needs the RocksDB state store (``run_meetings`` sets it).
    """
    config = config or Detection()
    ship_package(points.sparkSession)
    bucket_s = max(int(config.meeting_bucket_s), 1)
    timed = points.withColumn("ts", F.timestamp_seconds(F.col("bucket") + bucket_s)).withWatermark("ts", delay)
    left, right = cell_sides(timed, config, exact_grid)
    side = lambda df, s: df.select("bucket", "band", "to_x", *(F.col(c).alias(f"{c}_{s}") for c in ("ts", "mmsi", "latitude", "longitude", "seq")))
    a, b = side(left, "a"), side(right, "b").withColumnsRenamed({c: f"{c}_2" for c in ("bucket", "band", "to_x")})
    same = (F.col("ts_a") == F.col("ts_b")) & (F.col("band") == F.col("band_2")) & (F.col("to_x") == F.col("to_x_2"))
    km = haversine_km(F.col("latitude_a"), F.col("longitude_a"), F.col("latitude_b"), F.col("longitude_b"))
    close = a.join(b, same & (F.col("mmsi_a") < F.col("mmsi_b")) & (km <= config.meeting_km))
    places = [F.col(f"{c}_{s}").alias(f"{c[:3]}_{s}") for s in ("a", "b") for c in ("latitude", "longitude")]
    seen = close.select("mmsi_a", "mmsi_b", "bucket", "ts_a", km.alias("km"), "seq_a", "seq_b", *places)
    return seen.groupBy("mmsi_a", "mmsi_b").transformWithStateInPandas(PairMeetings(config.continuation_s, config.meeting_h, bucket_s), MEETINGS, "Append", "EventTime")


def run_meetings(points: DataFrame, path: str, checkpoint: str, config: Detection | None = None, delay: str = "1 hour", exact_grid: bool = False):
    """Process what there is and append the closed meetings to Parquet at ``path``; repeated runs go on where the last one ended."""
    spark = points.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, _ROCKSDB)
    try:
        query = stream_meetings(points, config, delay, exact_grid).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    finally:
        spark.conf.set(setting, before)
    query.awaitTermination()
    return query


def last_point(spark: SparkSession, bucket: int) -> DataFrame:
    """A point of no vessel at a later ``bucket``: appended to the input at the end of a stream it moves the watermark, so that all meetings close."""
    return spark.createDataFrame([(_NOBODY, bucket, 90.0, 0.0, 0)], POINTS)
