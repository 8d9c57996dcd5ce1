"""Map tables of the most conspicuous vessel, and small summaries of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vesselwatch.operators.meetings import by_vessel

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def of_top_vessel(events: DataFrame) -> DataFrame:
    """Events of the vessel (``mmsi``) with most of them, ties to the smallest; numbered in time as ``event_index``."""
    top = events.groupBy("mmsi").count().orderBy(F.desc("count"), "mmsi").limit(1).select("mmsi")
    return _numbered(events.join(F.broadcast(top), "mmsi", "left_semi"))  # one row


def _numbered(events: DataFrame) -> DataFrame:
    starts = [c for c in ("start_ts", "start_epoch") if c in events.columns]
    ends = [c for c in ("end_ts", "end_epoch") if c in events.columns]
    rest = [c for c in ("mmsi_a", "mmsi_b") if c in events.columns]
    return events.withColumn("event_index", F.row_number().over(Window.partitionBy("mmsi").orderBy(*starts, *ends, *rest)))


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def jump_map(events: DataFrame, subtype: str | None = None) -> DataFrame:
    """Map rows of the top vessel by jumps; ``subtype`` D1 or D2 (of D2 those that count)."""
    if subtype:
        events = events.where(F.col("subtype") == subtype)
    if subtype == "D2":
        events = events.where("counts")
    return of_top_vessel(events).select(
        "mmsi", "event_index", "subtype", F.date_format("start_ts", ISO).alias("point_a_timestamp"), F.col("start_latitude").alias("point_a_latitude"),
        F.col("start_longitude").alias("point_a_longitude"), F.date_format("end_ts", ISO).alias("point_b_timestamp"), F.col("end_latitude").alias("point_b_latitude"),
        F.col("end_longitude").alias("point_b_longitude"), "gap_hours", "implied_speed_knots", "distance_km", _flag("start_on_land").alias("point_a_on_land"),
        _flag("end_on_land").alias("point_b_on_land"), "quality_flag", F.col("counts").cast("string").alias("counts_for_dfsi"),
    )


def silence_map(events: DataFrame) -> DataFrame:
    return of_top_vessel(events).select(
        "mmsi", "event_index", F.col("start_latitude").alias("lat_origin"), F.col("start_longitude").alias("lon_origin"), F.col("end_latitude").alias("lat_destination"),
        F.col("end_longitude").alias("lon_destination"), "gap_hours", "distance_km",
    )


def meeting_map(events: DataFrame, of_one: bool = False) -> DataFrame:
    """Map rows of the top vessel by meetings. ``of_one``: ``events`` are those of the top vessel, which is their ``mmsi``."""
    iso = lambda c: F.date_format(F.timestamp_seconds(F.col(c)), ISO)
    top = _numbered(events) if of_one else of_top_vessel(by_vessel(events))
    return top.select(
        F.col("mmsi").alias("focus_mmsi"), "event_index", "mmsi_a", "mmsi_b", iso("start_epoch").alias("start_timestamp"), iso("end_epoch").alias("end_timestamp"), "duration_hours",
        "start_lat_a", "start_lon_a", "start_lat_b", "start_lon_b", "end_lat_a", "end_lon_a", "end_lat_b", "end_lon_b", "min_distance_km", "avg_distance_km",
    )


def bounding_box(events: DataFrame) -> DataFrame:
    """Least and greatest coordinates over both ends."""
    lat, lon = ("start_latitude", "end_latitude"), ("start_longitude", "end_longitude")
    return events.agg(
        F.min(F.least(*lat)).alias("min_latitude"), F.max(F.greatest(*lat)).alias("max_latitude"), F.min(F.least(*lon)).alias("min_longitude"), F.max(F.greatest(*lon)).alias("max_longitude")
    )


def latitude_split(events: DataFrame) -> DataFrame:
    """``threshold``: the middle of the widest gap between neighbouring latitudes of the ends; the southernmost of equals.

    Latitudes are ordered within bands of 1/256 degree, whose ends (at most 46081 rows) close the gaps between bands.
    """
    lats = events.select(F.explode(F.array("start_latitude", "end_latitude")).alias("lat")).distinct().withColumn("band", F.floor(F.col("lat") * 256))
    inside = lats.select("lat", F.lag("lat").over(Window.partitionBy("band").orderBy("lat")).alias("south"))
    bands = lats.groupBy("band").agg(F.min("lat").alias("low"), F.max("lat").alias("high"))
    across = bands.select(F.col("low").alias("lat"), F.lag("high").over(Window.orderBy("band")).alias("south"))
    gaps = inside.union(across).where("south is not null")
    return gaps.agg(F.max_by((F.col("lat") + F.col("south")) / 2, F.struct(F.col("lat") - F.col("south"), -F.col("lat"))).alias("threshold"))
