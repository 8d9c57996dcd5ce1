"""Per-vessel tracks: one exchange by vessel serves sampling and the detectors A, C and D."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from vesselwatch.config import Detection
from vesselwatch.functions.geo import haversine_km, land_by_cell, ports_by_cell, speed_knots, with_near_port, with_on_land

#: A rule for the quality of a D2.
Classifier = Callable[[Column, Column, Column], Column]
POINT = ["ts", "latitude", "longitude", "draught"]


def in_track(*group: str) -> WindowSpec:
    """The window of all track functions: a vessel's records in time, within ``group`` if given."""
    return Window.partitionBy("mmsi", *group).orderBy("ts", "seq")


def epoch(c: str) -> Column:
    return F.unix_seconds(F.col(c))


def bucket(c: Column, seconds: int) -> Column:
    """Start of the epoch-anchored bucket."""
    return F.floor(c / seconds).cast("long") * seconds


def first_in_bucket(seconds: int, w: WindowSpec, before: Column | None = None) -> Column:
    """True for a vessel's first record of each bucket; every record for no seconds. ``before``: time of the last record before the window."""
    if seconds <= 0:
        return F.lit(True)
    own = bucket(epoch("ts"), seconds)
    last = F.lag(own).over(w)
    return ~own.eqNullSafe(last if before is None else F.coalesce(last, bucket(F.unix_seconds(before), seconds)))


def whole_buckets(config: Detection) -> int:
    """Seconds of the least slice that holds whole sampling buckets."""
    return math.lcm(*(max(1, int(s)) for s in (config.track_sample_s, config.meeting_sample_s)))


def hot_vessels(records: DataFrame, share: float = 1 / 200, least: int = 1_000_000, tracked: int = 10_000) -> list[int]:
    """Vessels with over ``share`` and over ``least`` of the records, by a sketch of frequent items: one pass over one column.

    At most ``1 / share`` vessels can be found. The sketch never counts too few, and at most a few ``1 / tracked`` of all rows too many.
    """
    found = records.agg(F.count("mmsi").alias("n"), F.expr(f"approx_top_k(mmsi, {int(1 / share) + 1}, {tracked})").alias("top")).first()
    return sorted(x["item"] for x in found["top"] or [] if x["count"] > max(least, share * found["n"]))


def with_track_columns(records: DataFrame, config: Detection, slice_s: int | None = None, hot: Sequence[int] = (), carried: DataFrame | None = None) -> DataFrame:
    """Records with their predecessor (``prev``), sample flags and the preceding track sample (``sample``).

    ``records``: mmsi, ts, seq (any type that sorts; breaks ties of time), latitude, longitude, sog, draught. All window
    functions share one partitioning and one order, so there is one exchange and one sort.

    The tracks of ``hot`` vessels, or all with ``slice_s`` (seconds), are cut into slices (column ``part``, null for whole tracks), each a
    group of its own; what the first records of a slice need of earlier ones is looked up in a small table with a row for
    each slice. The result is the same.

    ``carried`` (mmsi, last, last_sample; both structs of ``POINT``) is what earlier runs left: tracks go on from there.
    """
    here, order = F.struct(*POINT), F.struct("ts", "seq")
    sliced = slice_s is not None or len(hot) > 0
    if slice_s is not None and any(s > 0 and slice_s % s for s in (config.track_sample_s, config.meeting_sample_s)):
        raise ValueError("a slice must hold whole sampling buckets")  # so that its first record begins new ones
    group: list[str] = []
    before: dict[str, Column] = {"last": F.lit(None), "last_sample": F.lit(None)}
    if sliced:
        group = ["part"]
        cut = bucket(epoch("ts"), slice_s or whole_buckets(config))
        records = records.withColumn("part", cut if slice_s is not None else F.when(F.col("mmsi").isin(list(hot)), cut))
        edges = _slice_edges(records.where("part is not null"), config, carried)
        if carried is not None and slice_s is None:
            edges = edges.unionByName(carried.where(~F.col("mmsi").isin(list(hot))).select("mmsi", F.lit(None).cast("long").alias("part"), "last", "last_sample"))
    elif carried is not None:
        edges = carried.select("mmsi", "last", "last_sample")
    if sliced or carried is not None:
        edges = edges.withColumnsRenamed({c: f"__{c}" for c in ("mmsi", "part", "last", "last_sample")})
        same = F.col("mmsi") == F.col("__mmsi")
        records = records.join(edges, same & F.col("part").eqNullSafe(F.col("__part")) if sliced else same, "left")
        before = {c: F.col(f"__{c}") for c in before}
    w = in_track(*group)
    last_ts = before["last"]["ts"] if sliced or carried is not None else None
    flagged = records.select(
        "mmsi", *group, "seq", *POINT, "sog", *(F.col(f"__{c}") for c in before if last_ts is not None),
        F.lag(here).over(w).alias("prev"),
        first_in_bucket(config.track_sample_s, w, last_ts).alias("is_sample"),
        first_in_bucket(config.meeting_sample_s, w, last_ts).alias("is_meeting_sample"),
    )
    sample = F.last(F.when(F.col("is_sample"), here), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    if last_ts is None:
        return flagged.withColumn("sample", sample)
    return flagged.withColumn("sample", F.coalesce(sample, "__last_sample")).withColumn("prev", F.coalesce("prev", "__last")).drop("__last", "__last_sample")


def _slice_edges(records: DataFrame, config: Detection, carried: DataFrame | None) -> DataFrame:
    """(mmsi, part, last, last_sample): the records before each slice. Both are grouped extremes, combined before the shuffle."""
    here, order = F.struct(*POINT), F.struct("ts", "seq")
    seconds = config.track_sample_s
    own = bucket(epoch("ts"), seconds).alias("own") if seconds > 0 else F.col("ts").alias("own")
    by_bucket = records.groupBy("mmsi", "part", own).agg(F.max_by(here, order).alias("last"), F.min_by(here, order).alias("first"))
    sample = F.max_by("first", "own") if seconds > 0 else F.max_by("last", "own")
    ends = by_bucket.groupBy("mmsi", "part").agg(F.max_by("last", "own").alias("last"), sample.alias("last_sample"))
    slices = Window.partitionBy("mmsi").orderBy("part")  # a row for each slice of a vessel
    edges = ends.select("mmsi", "part", *(F.lag(c).over(slices).alias(c) for c in ("last", "last_sample")))
    if carried is None:
        return edges
    old = carried.select("mmsi", F.col("last").alias("old"), F.col("last_sample").alias("old_sample"))
    return edges.join(old, "mmsi", "left").select("mmsi", "part", F.coalesce("last", "old").alias("last"), F.coalesce("last_sample", "old_sample").alias("last_sample"))


def _gap_seconds(start: str) -> Column:
    return epoch("ts") - F.unix_seconds(F.col(f"{start}.ts"))


def _km(start: str) -> Column:
    return haversine_km(F.col(f"{start}.latitude"), F.col(f"{start}.longitude"), F.col("latitude"), F.col("longitude"))


def detect(records: DataFrame, config: Detection | None = None, ports: DataFrame | None = None, land: DataFrame | None = None, quality: Classifier | None = None, **tracks) -> DataFrame:
    """``candidates`` after the look-ups: draught changes at sea only, jumps with their quality.

    ``ports`` None: draught changes count everywhere; ``land`` None: no D2 can be trusted. A filter on either kind
    of event is pushed below the look-ups, which are left joins. ``quality`` as in ``with_quality``; ``tracks``: further arguments of ``with_track_columns``.
    """
    config = config or Detection()
    return with_quality(without_port_changes(candidates(records, config, **tracks), config, ports), config, ports, land, quality)


def detect_draught(records: DataFrame, config: Detection, ports: DataFrame | None, **tracks) -> DataFrame:
    """``candidates`` with draught changes at sea only."""
    return without_port_changes(candidates(records, config, **tracks), config, ports)


def detect_jumps(records: DataFrame, config: Detection, ports: DataFrame | None, land: DataFrame | None, quality: Classifier | None = None, **tracks) -> DataFrame:
    """``candidates`` with the quality of jumps."""
    return with_quality(candidates(records, config, **tracks), config, ports, land, quality)


def candidates(records: DataFrame, config: Detection | None = None, **tracks) -> DataFrame:
    """Tracks with the findings of A, C and D beside each record, before any look-up; flags are never null.

    Silence (``is_silence``) and draught change (``is_draught_change``) compare track samples, jumps
    (``subtype`` D1 or D2, else null) consecutive records.
    """
    config = config or Detection()
    t = with_track_columns(records, config, **tracks).select(
        "*",
        (_gap_seconds("sample") / 3600.0).alias("sample_hours"), _km("sample").alias("sample_km"),
        _gap_seconds("prev").alias("prev_seconds"), _km("prev").alias("prev_km"),
    )
    t = t.withColumn("prev_hours", F.col("prev_seconds") / 3600.0)
    old, new = F.col("sample.draught"), F.col("draught")
    change = F.when(old > 0, F.abs(new - old) / F.when(old > 0, old))
    sample = F.col("is_sample")
    silent = sample & (F.col("sample_hours") > config.silence_h) & (F.col("sample_km") > config.silence_km)
    changed = sample & (F.col("sample_hours") > config.draught_h) & (F.isnan(old) | (change > config.draught_share))
    changed = changed & old.isNotNull() & new.isNotNull()
    off_origin = lambda lat, lon: (F.col(lat) != 0) | (F.col(lon) != 0)
    knots = speed_knots(F.col("prev_km"), F.col("prev_hours"))
    fast = (
        (F.col("prev_seconds") >= config.jump_least_s) & off_origin("latitude", "longitude") & off_origin("prev.latitude", "prev.longitude")
        & (F.col("prev_km") > config.jump_km) & (knots > config.jump_knots)
    )
    subtype = F.when(fast & (F.col("prev_hours") <= config.clone_h), "D1").when(fast & (F.col("prev_hours") <= config.jump_h), "D2")
    return t.select(
        "*", F.coalesce(silent, F.lit(False)).alias("is_silence"), F.coalesce(changed, F.lit(False)).alias("is_draught_change"),
        knots.alias("knots"), subtype.alias("subtype"),
    )


def without_port_changes(t: DataFrame, config: Detection, ports: DataFrame | None) -> DataFrame:
    """Draught changes count only if both ends of the silence are at sea."""
    if ports is None:
        return t
    cells = ports_by_cell(ports, config.draught_port_km)
    t = t.withColumns({"__lat": F.col("sample.latitude"), "__lon": F.col("sample.longitude")})
    t = with_near_port(t, cells, "latitude", "longitude", "__near_end", F.col("is_draught_change"))
    t = with_near_port(t, cells, "__lat", "__lon", "__near_start", F.col("is_draught_change"))
    return t.withColumn("is_draught_change", F.col("is_draught_change") & ~F.col("__near_end") & ~F.col("__near_start")).drop("__lat", "__lon", "__near_end", "__near_start")


def usual_quality(start_on_land: Column, end_on_land: Column, near_port: Column) -> Column:
    """The flag of a D2: ok with both ends at sea, else suspect; without a mask the ends are null and no D2 is ok."""
    known = start_on_land.isNotNull() & end_on_land.isNotNull()
    return F.when(known & ~start_on_land & ~end_on_land, "ok").when(known & near_port, "suspect_land_point_near_port").otherwise("suspect_land_point")


def with_quality(t: DataFrame, config: Detection, ports: DataFrame | None, land: DataFrame | None, quality: Classifier | None = None) -> DataFrame:
    """start_on_land, end_on_land, quality and counts of jumps; D1 are ok and count.

    ``quality``: another rule than ``usual_quality``, a function of the same three columns. A D2 that it calls ok counts.
    """
    d2 = F.coalesce(F.col("subtype") == "D2", F.lit(False))
    t = t.withColumns({"__lat": F.col("prev.latitude"), "__lon": F.col("prev.longitude")})
    masks = land if land is None or "land_y" in land.columns else land_by_cell(land)  # a cover, or a mask to be covered
    t = with_on_land(t, masks, "__lat", "__lon", "start_on_land", d2)
    t = with_on_land(t, masks, "latitude", "longitude", "end_on_land", d2)
    near = F.lit(False)
    if ports is not None:
        cells = ports_by_cell(ports, config.jump_port_km)
        t = with_near_port(t, cells, "__lat", "__lon", "__near_start", d2)
        t = with_near_port(t, cells, "latitude", "longitude", "__near_end", d2)
        near = F.col("__near_start") | F.col("__near_end")
    flag = (quality or usual_quality)(F.col("start_on_land"), F.col("end_on_land"), near)
    flag = F.when(F.col("subtype") == "D1", "ok").when(d2, flag)
    return t.withColumn("quality_flag", flag).withColumn("counts", F.coalesce(F.col("quality_flag") == "ok", F.lit(False))).drop("__lat", "__lon", "__near_start", "__near_end")


def _ends(start: str) -> list[Column]:
    return [
        F.col(f"{start}.ts").alias("start_ts"), F.col("ts").alias("end_ts"), F.col(f"{start}.latitude").alias("start_latitude"),
        F.col(f"{start}.longitude").alias("start_longitude"), F.col("latitude").alias("end_latitude"), F.col("longitude").alias("end_longitude"),
    ]


def silences(detected: DataFrame) -> DataFrame:
    """Events A."""
    return detected.where("is_silence").select("mmsi", *_ends("sample"), F.col("sample_hours").alias("gap_hours"), F.col("sample_km").alias("distance_km"))


def draught_changes(detected: DataFrame) -> DataFrame:
    """Events C."""
    before = F.col("sample.draught")
    return detected.where("is_draught_change").select(
        "mmsi", *_ends("sample"), F.col("sample_hours").alias("gap_hours"), before.alias("start_draught"), F.col("draught").alias("end_draught"),
        F.abs(F.col("draught") - before).alias("absolute_change"), F.when(before > 0, F.abs(F.col("draught") - before) / F.when(before > 0, before)).alias("relative_change"),
    )


def jumps(detected: DataFrame) -> DataFrame:
    """Events D, both subtypes."""
    return detected.where("subtype is not null").select(
        "mmsi", "subtype", *_ends("prev"), F.col("prev_hours").alias("gap_hours"), F.col("prev_km").alias("distance_km"), F.col("knots").alias("implied_speed_knots"),
        "start_on_land", "end_on_land", "quality_flag", "counts",
    )
