"""Detection day by day: each run reads its own records and what the runs before it left, never the earlier records.

What stays of a vessel is one row: its summary so far, its last record, last track sample and latest D1 end. What stays of
meetings are the points of the newest bucket, which may still get points, and a vessel's points since the earliest of its sessions
still open began: points, as in a crowd there are far more open sessions. Where meetings are only counted (``list_meetings`` False) it is the points of as
many buckets as tell whether a session that ends later is long enough. Runs in the
order of time give the events and summaries of one run over all records, wherever the days are cut.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselwatch.config import Detection
from vesselwatch.operators import meetings as meet
from vesselwatch.operators import score, tracks
from vesselwatch.session import discard, remove, stored

#: The run that closes all meetings.
END = (1 << 31) - 1


class DailyDetection:
    """A folder of runs (``path``, shared by the cluster): ``silences``, ``draught_changes``, ``jumps`` and ``meetings`` by run, and the latest state.

    A run counts once its row in ``done`` is written, which is its last step: a run that failed is repeated and replaces what it
    had written. Runs with a number up to the last one are passed over, so nothing is merged twice.
    """

    EVENTS = ("silences", "draught_changes", "jumps", "meetings")

    def __init__(self, spark: SparkSession, path: str, config: Detection | None = None, ports: DataFrame | None = None, land: DataFrame | None = None, with_meetings: bool = True, exact_grid: bool = False, share: float | None = 1 / 200, least: int = 1_000_000, list_meetings: bool = True):
        self.spark, self.path, self.config, self.ports, self.land = spark, path, config or Detection(), ports, land
        self.with_meetings, self.exact_grid, self.share, self.least, self.list_meetings = with_meetings, exact_grid, share, least, list_meetings

    def _read(self, name: str, run: int | None = None) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}" + ("" if run is None else f"/run={run}"))
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing was written yet
                return None
            raise

    def _write(self, df: DataFrame, name: str, run: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/run={run}")

    def _last(self) -> tuple[int | None, int | None]:
        """(last run, the last bucket of meetings that it processed)."""
        done = self._read("done")  # a row for each run
        row = done.agg(F.max_by(F.struct("run", "upto"), "run").alias("last")).first()["last"] if done is not None else None
        return (row["run"], row["upto"]) if row else (None, None)

    def add(self, records: DataFrame, run: int) -> bool:
        """Merges a run's records (mmsi, ts, seq, latitude, longitude, sog, draught); False if that run, or a later one, was there before."""
        last, upto = self._last()
        if last is not None and run <= last:
            return False
        state = None if last is None else self._read("vessels", last)
        options: dict = {} if self.share is None else {"hot": tracks.hot_vessels(records, self.share, self.least)}
        if state is not None:
            options["carried"] = state.select("mmsi", "last", "last_sample")
        detected = tracks.detect(records, self.config, self.ports, self.land, **options)
        summary = score.merged(score.track_summaries(detected, self.config), self.config, state)
        self._write(summary, "vessels", run)
        # few records are part of an event or a meeting's point: these are kept from one pass over the tracks
        found = stored(detected.where("is_silence or is_draught_change or subtype is not null or is_meeting_sample"), "findings")
        for name, select in (("silences", tracks.silences), ("draught_changes", tracks.draught_changes), ("jumps", tracks.jumps)):
            self._write(select(found), name, run)
        if self.with_meetings:
            upto = self._meet(meet.meeting_points(found, self.config, self.ports), last, run, upto)
        discard(found)
        self._finish(run, upto, last)
        return True

    def close(self) -> None:
        """The end of all runs: meetings still open are events if they are long enough, with the points of the newest bucket."""
        last, upto = self._last()
        if last is None or last == END:
            return
        if self.with_meetings:
            self._meet(None, last, END, upto)
        self._write(self._read("vessels", last), "vessels", END)
        self._finish(END, upto, last)

    def _finish(self, run: int, upto: int | None, last: int | None) -> None:
        self._write(self.spark.createDataFrame([(upto,)], "upto long"), "done", run)
        if last is not None:  # no later run reads these
            for name in ("vessels", "pending"):
                remove(self.spark, f"{self.path}/{name}/run={last}")

    def _meet(self, points: DataFrame | None, last: int | None, run: int, upto: int | None) -> int | None:
        """Closes what is closed by all buckets but the newest, or all (``points`` None); returns the last bucket processed.

        Points of buckets that were processed before enter them as far as the bucket's other points are still there; sessions
        closed before are not told again.
        """
        held = self._read("pending", last) if last is not None else None
        if points is not None:
            points = points.withColumn("before", F.lit(None).cast("long"))
        if held is not None:
            points = held if points is None else points.unionByName(held)
        if points is None:
            return upto
        points = stored(points, "points")
        newest = points.agg(F.max("bucket")).first()[0]
        ready = points if run == END else points.where(F.col("bucket") < newest)
        # vessels without open sessions are gone from processed buckets, so these keep what was found when all were there
        occupied = ready.where("before is null").select("bucket")
        if upto is not None:
            occupied = occupied.unionByName(self.spark.createDataFrame([(upto,)], "bucket long"))
        found = meet.previous_occupied(occupied).withColumnRenamed("before", "found")
        ready = stored(ready.join(found, "bucket", "left").select("mmsi", "bucket", "latitude", "longitude", "seq", F.coalesce("before", "found").alias("before")), "points")
        gap, told_to = self.config.continuation_s, upto
        upto = max((x for x in (upto, ready.agg(F.max("bucket")).first()[0]) if x is not None), default=None)
        open_after = None if run == END or upto is None else upto - gap - 1
        if not self.list_meetings:
            self._count(ready, points.where(F.col("bucket") >= newest), run, told_to, upto)
            discard(points, ready)
            return upto
        # long sessions that are closed, and since when vessels have others that are open: far fewer than all sessions
        sessions = stored(meet.sessions_of(ready, self.config, self.exact_grid, least_h=self.config.meeting_h, open_after=open_after), "sessions")
        told = F.lit(False) if told_to is None else F.lit(told_to) - F.col("end_epoch") > gap
        self._write(sessions.where(F.col("mmsi_b").isNotNull() & ~told), "meetings", run)
        since = sessions.where("mmsi_b is null").groupBy("mmsi_a").agg(F.min("start_epoch").alias("since"))
        kept = ready.join(since, F.col("mmsi") == F.col("mmsi_a")).where("bucket >= since").drop("mmsi_a", "since")
        self._write(kept.unionByName(points.where(F.col("bucket") >= newest)) if run != END else points.where(F.lit(False)), "pending", run)
        discard(points, ready, sessions)
        return upto

    def _count(self, ready: DataFrame, newest: DataFrame, run: int, told_to: int | None, upto: int | None) -> None:
        """Vessels' numbers of the long sessions that are closed by now and weren't before; keeps the points that later ones take."""
        gap = self.config.continuation_s
        ends = (None if told_to is None else told_to - gap, None if run == END or upto is None else upto - gap)
        self._write(meet.session_counts(ready, self.config, self.exact_grid, least_h=self.config.meeting_h, ends=ends), "meeting_counts", run)
        if run == END or upto is None:
            kept = ready.where(F.lit(False))
        else:  # a session that ends from upto - gap on, as far back as it must reach, and what its first buckets may go on from
            since = upto - gap - math.ceil(self.config.meeting_h * 3600)
            before = ready.where(F.col("bucket") >= since).agg(F.min("before")).first()[0]
            kept = ready.where(F.col("bucket") >= min(since, since if before is None else before) - gap)
        self._write(kept if run == END else kept.unionByName(newest), "pending", run)

    def _counts(self) -> DataFrame | None:
        last, found = self._last()[0], self._read("meeting_counts")
        return None if found is None else found.where(F.col("run") <= last).groupBy("mmsi").agg(F.sum("n").alias("n"))

    def events(self, kind: str) -> DataFrame | None:
        """All events of a kind (``EVENTS``) of the runs that are done."""
        last, found = self._last()[0], self._read(kind)
        return None if last is None or found is None else found.where(F.col("run") <= last).drop("run")

    def vessels(self) -> DataFrame | None:
        """One scored row per vessel, as of the last run."""
        last, _ = self._last()
        if last is None:
            return None
        summary = self._read("vessels", last).drop("d1_end", "last", "last_sample")
        listed = self.with_meetings and self.list_meetings
        return score.with_score(score.with_meetings(summary, self.events("meetings") if listed else None, self._counts() if self.with_meetings and not listed else None))
