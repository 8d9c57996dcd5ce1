"""CSV outputs in a fixed column order."""

from __future__ import annotations

import json
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from vesselwatch.config import Detection
from vesselwatch.session import write_small_file

#: Fixed values of the output format: header names over our columns, with a number format where one applies.
VESSELS = [
    ("MMSI", "mmsi", None), ("DFSI", "score", "%.6f"), ("record_count", "record_count", None), ("max_gap_hours", "max_gap_hours", "%.3f"),
    ("impossible_relocation_km_d2", "impossible_jump_km", "%.3f"), ("draft_change_count", "draught_events", None), ("going_dark_events", "silence_events", None),
    ("draft_change_events", "draught_events", None), ("teleportation_events", "jump_events", None), ("teleportation_d1_events", "d1_events", None),
    ("d1_episode_count", "d1_episodes", None), ("teleportation_d2_events", "d2_events", None), ("teleportation_d2_valid_events", "d2_valid_events", None),
    ("teleportation_d2_flagged_events", "d2_flagged_events", None), ("loitering_transfer_events", "meeting_events", None),
]
JUMPS = [
    "mmsi", "event_index", "subtype", "point_a_timestamp", "point_a_latitude", "point_a_longitude", "point_b_timestamp", "point_b_latitude", "point_b_longitude",
    "gap_hours", "implied_speed_knots", "distance_km", "point_a_on_land", "point_b_on_land", "quality_flag", "counts_for_dfsi",
]
SILENCES = ["mmsi", "event_index", "lat_origin", "lon_origin", "lat_destination", "lon_destination", "gap_hours", "distance_km"]
MEETINGS = [
    "focus_mmsi", "event_index", "mmsi_a", "mmsi_b", "start_timestamp", "end_timestamp", "duration_hours", "start_lat_a", "start_lon_a", "start_lat_b",
    "start_lon_b", "end_lat_a", "end_lon_a", "end_lat_b", "end_lon_b", "min_distance_km", "avg_distance_km",
]


#: Rows that are written to a single file, at most; more stay ordered in several.
ONE_FILE = 1_000_000
#: A micro-batch's progress as Spark reports it, in part.
PROGRESS = """id string, batchId long, numInputRows long, durationMs map<string, long>, stateOperators array<struct<numRowsTotal long, numRowsUpdated long, memoryUsedBytes long>>,
  observedMetrics struct<profile struct<raw long, valid long, vessels long, track_samples long, meeting_samples long>>"""


def _seconds(*phases: str) -> str:
    return "(" + " + ".join(f"coalesce(durationMs['{x}'], 0)" for x in phases) + ") / 1000"


def _state(name: str) -> str:
    return f"aggregate(coalesce(stateOperators, array()), 0L, (n, s) -> n + coalesce(s.{name}, 0L))"


#: Fixed values of the profile's header: where each comes from in a stream's progress.
PROFILE = {
    "chunk_id": "batchId", "raw_row_count": "coalesce(observedMetrics.profile.raw, numInputRows)", "valid_record_count": "observedMetrics.profile.valid", "vessel_count": "observedMetrics.profile.vessels",
    "ac_sampled_record_count": "observedMetrics.profile.track_samples", "loitering_sampled_record_count": "observedMetrics.profile.meeting_samples",
    "worker_elapsed_sec": _seconds("addBatch"), "queue_wait_sec": _seconds("latestOffset", "getBatch", "queryPlanning"), "merge_elapsed_sec": _seconds("walCommit", "commitOffsets"),
    "pending_results_before_merge": f"{_state('numRowsTotal')} - {_state('numRowsUpdated')}", "pending_results_after_merge": _state("numRowsTotal"),
    "main_rss_mb_after_merge": f"{_state('memoryUsedBytes')} / 1e6",
}


class ProgressLog(StreamingQueryListener):
    """Keeps the progress of every micro-batch of a stream in a folder, a small file each, however long the stream runs.

    Spark itself keeps the last ones only. A micro-batch that is repeated after a restart replaces its file. ``query``: the id of the stream
    to follow, else all.
    """

    def __init__(self, spark: SparkSession, path: str, query: str | None = None):
        self.spark, self.path, self.query, self.ended = spark, path, query, threading.Event()
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.query in (None, str(p.id)):
            write_small_file(self.spark, f"{self.path}/{p.id}-{p.batchId:012d}.json", json.dumps(json.loads(p.json)))

    def onQueryTerminated(self, event) -> None:
        if self.query in (None, str(event.id)):
            self.ended.set()

    def stop(self, seconds: float = 30) -> None:
        """After the stream's end: waits for its last progress, which comes a little later."""
        self.ended.wait(seconds)
        self.spark.streams.removeListener(self)


def _ordered(df: DataFrame, order: list[str], columns: list, path: str) -> None:
    """Rows in order: one file of a few, else part files whose names sort as their rows do."""
    few = df.limit(ONE_FILE + 1).count() <= ONE_FILE
    df = df.orderBy(*order).select(*columns)
    (df.coalesce(1) if few else df).write.mode("overwrite").option("header", True).csv(path)


def write_vessels(ranked: DataFrame, path: str) -> None:
    """The ranked vessel table in rank order."""
    _ordered(ranked, ["rank"], [(F.format_string(f, F.col(c)) if f else F.col(c)).alias(h) for h, c, f in VESSELS], path)


def write_map_table(rows: DataFrame, columns: list[str], path: str) -> None:
    _ordered(rows, ["event_index"], columns, path)


def profiled(raw: DataFrame, valid: Column, config: Detection) -> DataFrame:
    """``raw`` (typed rows: mmsi, ts) with the counts that a stream's progress needs for its profile; distinct ones are approximate."""
    at = F.unix_seconds("ts")
    distinct = lambda *c: F.approx_count_distinct(F.when(valid, F.struct(*c)), 0.02)
    buckets = [F.floor(at / max(s, 1)).alias("b") for s in (config.track_sample_s, config.meeting_sample_s)]
    return raw.observe(
        "profile", F.count("*").alias("raw"), F.count_if(valid).alias("valid"), distinct("mmsi").alias("vessels"), distinct("mmsi", buckets[0]).alias("track_samples"), distinct("mmsi", buckets[1]).alias("meeting_samples")
    )


def write_profile(progress: list | str, spark: SparkSession, path: str) -> None:
    """A row for each of a stream's micro-batches: rows, times in seconds, rows and MB of state.

    ``progress``: the folder of a ``ProgressLog``, or a list of progress reports, such as a query's recent ones. Of a micro-batch that
    was reported more than once (also without new input) the report with the most rows counts.
    """
    if isinstance(progress, str):
        lines = spark.read.text(progress)
    else:
        lines = spark.createDataFrame([(p.json if hasattr(p, "json") else json.dumps(p, default=_plain),) for p in progress], "value string")
    reports = lines.select(F.from_json("value", PROGRESS).alias("p"))
    reports = reports.groupBy("p.id", "p.batchId").agg(F.max_by("p", "p.numInputRows").alias("p")).select("p.*")
    whole = [c for c in PROFILE if c.endswith(("_id", "_count", "_merge")) and "rss" not in c]
    table = reports.select(*(F.expr(f"cast({x} as {'long' if c in whole else 'double'})").alias(c) for c, x in PROFILE.items()))
    _ordered(table, ["chunk_id"], [F.col(c) if c in whole else F.round(c, 3).alias(c) for c in PROFILE], path)


def _plain(value):
    return value.asDict() if hasattr(value, "asDict") else str(value)
