"""The whole detection as one set of DataFrames, each planned when it is first asked for."""

from __future__ import annotations

from functools import cached_property
from uuid import uuid4

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vesselwatch.config import Detection
from vesselwatch.functions.geo import land_by_cell
from vesselwatch.operators import meetings as meet
from vesselwatch.operators import score, tracks
from vesselwatch.session import stored


class Result:
    """Lazy results over ``records`` (mmsi, ts, seq, latitude, longitude, sog, draught)."""

    def __init__(self, records: DataFrame, ports: DataFrame | None, land: DataFrame | None, config: Detection, with_meetings: bool, exact_grid: bool, strict_gap: bool, slice_s: int | None, share: float | None = None, least: int = 1_000_000, quality: tracks.Classifier | None = None):
        self.records, self.ports, self.land, self.config = records, ports, land, config
        self.with_meetings, self.exact_grid, self.strict_gap, self.slice_s, self.share, self.least = with_meetings, exact_grid, strict_gap, slice_s, share, least
        self.quality = quality
        self.observed: dict[str, Observation] = {}

    @cached_property
    def tracks(self) -> dict:
        """How tracks are cut: as asked for, else those of vessels that a sketch finds to be hot."""
        if self.slice_s is not None or self.share is None:
            return {"slice_s": self.slice_s}
        return {"hot": tracks.hot_vessels(self.records, self.share, self.least)}

    @cached_property
    def _parts(self) -> DataFrame:
        return tracks.detect(self.records, self.config, self.ports, self.land, self.quality, **self.tracks)

    @cached_property
    def detected(self) -> DataFrame:
        """The shared plan behind all but silences and meetings, which need no look-up."""
        return self._parts.drop("part")

    @cached_property
    def silences(self) -> DataFrame:
        return tracks.silences(tracks.candidates(self.records, self.config, **self.tracks))

    @cached_property
    def draught_changes(self) -> DataFrame:
        return tracks.draught_changes(tracks.detect_draught(self.records, self.config, self.ports, **self.tracks))

    @cached_property
    def jumps(self) -> DataFrame:
        return tracks.jumps(tracks.detect_jumps(self.records, self.config, self.ports, self.land, self.quality, **self.tracks))

    @cached_property
    def meetings(self) -> DataFrame:
        points = tracks.with_track_columns(self.records, self.config, **self.tracks)
        return meet.meetings(points, self.config, self.ports if self.with_meetings else None, self.exact_grid, self.strict_gap)

    @cached_property
    def meeting_counts(self) -> DataFrame:
        """(mmsi, n): the numbers of vessels' meetings. Meetings that have been asked for are counted, else none is listed."""
        if "meetings" in self.__dict__:
            return meet.counted(self.meetings)
        points = tracks.with_track_columns(self.records, self.config, **self.tracks)
        return meet.meeting_counts(points, self.config, self.ports if self.with_meetings else None, self.exact_grid, self.strict_gap)

    @cached_property
    def top_meetings(self) -> DataFrame:
        """Meetings of the vessel (``mmsi``) with most of them, ties to the smallest. All are counted, but none is listed of others."""
        points = tracks.with_track_columns(self.records, self.config, **self.tracks)
        points = stored(meet.meeting_points(points, self.config, self.ports if self.with_meetings else None), "points")
        options = (self.config, self.exact_grid, self.strict_gap, self.config.meeting_h)
        top = meet.session_counts(points, *options).orderBy(F.desc("n"), "mmsi").first()
        return meet.sessions_with(points, -1 if top is None else top["mmsi"], *options).select(F.lit(-1 if top is None else top["mmsi"]).cast("long").alias("mmsi"), "*")

    @cached_property
    def vessels(self) -> DataFrame:
        """One scored row per vessel. Meetings that no one has asked for are counted from the tracks' points, which one pass over the tracks keeps beside what the vessels' sums take."""
        if self.with_meetings and not {"meetings", "meeting_counts"} & set(self.__dict__):
            land = stored(land_by_cell(self.land), "land") if self.land is not None else None  # its long plan would be part of the tracks' for either end of a jump
            detected = tracks.detect(self.records, self.config, self.ports, land, self.quality, **self.tracks)
            detected = meet.with_meeting_point(detected, self.config, self.ports)
            records = stored(score.narrowed(detected, self.config, "meeting_point"), "records")
            points = records.where("meeting_point is not null").select("mmsi", "meeting_point.*")
            counts = meet.session_counts(points, self.config, self.exact_grid, self.strict_gap, self.config.meeting_h)
            return score.with_score(score.vessel_summary(records, None, self.config, counts))
        return score.with_score(score.vessel_summary(self._parts, None, self.config, self.meeting_counts if self.with_meetings else None))

    def ranked(self) -> DataFrame:
        return score.ranked(self.vessels)

    def kept(self) -> Result:
        """The same with each kind of event and the vessels written once: for several reports of one run. Rows are counted as they are written."""
        again = Result(self.records, self.ports, self.land, self.config, self.with_meetings, self.exact_grid, self.strict_gap, self.slice_s, self.share, self.least, self.quality)
        again.__dict__["tracks"] = self.tracks
        for name in ("silences", "draught_changes", "jumps", "meetings", "vessels"):  # the vessels' meetings are read, not found again
            seen = Observation(f"{name}-{uuid4().hex}")
            counts = [F.count(F.lit(1)).alias("rows")] + ([F.coalesce(F.sum("record_count"), F.lit(0)).alias("records")] if name == "vessels" else [])
            again.__dict__[name] = stored(getattr(again, name).observe(seen, *counts), name)
            again.observed[name] = seen
        return again

    def metrics(self) -> dict[str, int]:
        """Rows of each result: records, vessels, and events by kind. Of ``kept`` results they were observed while those were written: no job."""
        if not self.observed:
            return self.kept().metrics()
        found = {name: seen.get for name, seen in self.observed.items()}
        return {"records": found["vessels"]["records"]} | {name: counts["rows"] for name, counts in found.items()}


def run_detection(records: DataFrame, ports: DataFrame | None = None, land: DataFrame | None = None, config: Detection | None = None, with_meetings: bool = True, exact_grid: bool = False, strict_gap: bool = False, slice_s: int | None = None, share: float | None = 1 / 200, least: int = 1_000_000, quality: tracks.Classifier | None = None) -> Result:
    """All detectors and the vessel table. Tracks of vessels with over ``share`` and over ``least`` of all records are cut into slices, if
    there are any (``share`` None: none is looked for); with ``slice_s`` all are. ``quality``: a rule for D2 as in ``with_quality``.
    """
    return Result(records, ports, land, config or Detection(), with_meetings, exact_grid, strict_gap, slice_s, share, least, quality)
