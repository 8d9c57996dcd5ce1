"""B: two slow vessels staying close together, from samples to sessions.

Observations of a pair are the occupied time buckets in which both have a sample in neighbouring grid cells
and within the distance. A session ends only when some later occupied bucket (one with a candidate of any
vessel) lies beyond the continuation gap and the pair isn't in it; hence a new session starts at t2 after
t1 if the last occupied bucket before t2 is further than the gap from t1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vesselwatch.config import Detection
from vesselwatch.functions.geo import grid_degrees, haversine_km, ports_by_cell, with_near_port
from vesselwatch.operators import crowds
from vesselwatch.operators.crowds import crowded_counts, crowded_pairs, crowded_sessions, ranges_for
from vesselwatch.operators.tracks import bucket, epoch
from vesselwatch.session import stored

#: Points of a cell and bucket that are compared with its neighbourhood in one group.
DENSE = 1000
#: Ranges that occupied buckets are ordered in, so that no single task orders all of them.
RANGE_BUCKETS = 4096


def meeting_points(tracks: DataFrame, config: Detection, ports: DataFrame | None) -> DataFrame:
    """Candidates: samples (taken before any filter) that are slow and not near a port.

    Without a catalogue (None) there are none; an empty catalogue excludes nothing.
    """
    points = tracks.where("is_meeting_sample").where(_slow(config))
    if ports is None:
        points = points.where(F.lit(False))
    else:
        points = with_near_port(points, ports_by_cell(ports, config.meeting_port_km), "latitude", "longitude", "near_port").where(~F.col("near_port"))
    return points.select("mmsi", *_point(config))


def _slow(config: Detection) -> Column:
    return (F.col("sog") < config.meeting_knots) | F.isnan("sog")


def _point(config: Detection) -> list[Column]:
    return [bucket(epoch("ts"), max(config.meeting_bucket_s, 1)).alias("bucket"), F.col("latitude"), F.col("longitude"), F.col("seq")]


def with_meeting_point(tracks: DataFrame, config: Detection, ports: DataFrame | None) -> DataFrame:
    """``meeting_point``: beside each record that is one of ``meeting_points`` its columns there but for the vessel, else null."""
    if ports is None:
        return tracks.withColumn("meeting_point", F.when(F.lit(False), F.struct(*_point(config))))
    wanted = F.coalesce(F.col("is_meeting_sample") & _slow(config), F.lit(False))
    near = with_near_port(tracks, ports_by_cell(ports, config.meeting_port_km), "latitude", "longitude", "__near_port", wanted)
    return near.withColumn("meeting_point", F.when(wanted & ~F.col("__near_port"), F.struct(*_point(config)))).drop("__near_port")


def cell_sides(points: DataFrame, config: Detection, exact_grid: bool = False) -> tuple[DataFrame, DataFrame]:
    """The sides of an equi-join on (bucket, band, to_x): each point in its cell, and in its own and the eight neighbouring cells.

    Longitude cells do not shrink with latitude, so pairs at high latitudes can be missed; ``exact_grid`` finds all.
    """
    size = grid_degrees(config.meeting_km)
    lat, lon = F.col("latitude"), F.col("longitude")
    celled = points.withColumn("cy", F.floor(lat / size))
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    if exact_grid:  # both sides take the width of the left side's band, from its number; the cells of a band go round the earth
        farthest = F.least(F.lit(90.0), F.greatest(F.abs("band"), F.abs(F.col("band") + 1)) * size + size)
        cells = F.greatest(F.lit(1), F.floor(360 * F.greatest(F.lit(0.0), F.cos(F.radians(farthest))) / size)).cast("long")
        cx = F.floor(F.pmod(lon + 180, F.lit(360.0)) / (F.lit(360.0) / cells))
        left = celled.withColumn("band", F.col("cy")).withColumn("to_x", F.pmod(cx, cells))
        right = celled.select("*", F.explode(near).alias("dy")).withColumn("band", F.col("cy") + F.col("dy"))
        right = right.select("*", F.explode(F.array_distinct(F.transform(near, lambda k: F.pmod(cx + k, cells)))).alias("to_x"))
    else:
        left = celled.withColumn("to_x", F.floor(lon / size)).withColumn("band", F.col("cy"))
        right = celled.select("*", F.explode(near).alias("dy")).withColumn("band", F.col("cy") + F.col("dy"))
        right = right.select("*", F.explode(F.transform(near, lambda k: F.floor(lon / size) + k)).alias("to_x"))
    return left.drop("cy"), right.drop("cy", "dy")


def pair_observations(points: DataFrame, config: Detection, exact_grid: bool = False) -> DataFrame:
    """(mmsi_a < mmsi_b, bucket, positions, km): each pair's closest observation of a bucket.

    An equi-join by grid cell (``cell_sides``). A cell with over ``DENSE`` points of a bucket, such as an anchorage, is cut into blocks,
    which meet the neighbourhood one by one. Where pairs are far more than points they aren't shuffled at all (``crowds``).
    """
    if (bounds := ranges_for(points, config, None, True)) is not None:
        return crowded_pairs(points, bounds, config, exact_grid)
    left, right = cell_sides(points, config, exact_grid)
    cell = ["bucket", "band", "to_x"]
    blocks = left.groupBy(*cell).agg(F.ceil(F.count("*") / DENSE).cast("int").alias("blocks")).where("blocks > 1")
    cut = lambda side: side.join(blocks, cell, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    a = left.select("bucket", "band", "to_x", *(F.col(c).alias(f"{c}_a") for c in ("mmsi", "latitude", "longitude", "seq")))
    b = right.select("bucket", "band", "to_x", *(F.col(c).alias(f"{c}_b") for c in ("mmsi", "latitude", "longitude", "seq")))
    km = haversine_km(F.col("latitude_a"), F.col("longitude_a"), F.col("latitude_b"), F.col("longitude_b"))
    a = cut(a).withColumn("block", F.pmod(F.xxhash64("mmsi_a"), "blocks").cast("int")).drop("blocks")
    b = cut(b).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    # few bytes but up to DENSE comparisons a row: adaptive execution, which goes by bytes, must not put these partitions together
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = a.repartition(n, *cell, "block"), b.repartition(n, *cell, "block")
    close = a.join(b, [*cell, "block"]).where((F.col("mmsi_a") < F.col("mmsi_b")) & (km <= config.meeting_km)).withColumn("km", km)
    return _closest(close)


def _closest(pairs: DataFrame) -> DataFrame:
    best = F.min_by(F.struct("latitude_a", "longitude_a", "latitude_b", "longitude_b", "km"), F.struct("km", "seq_a", "seq_b"))
    return pairs.groupBy("mmsi_a", "mmsi_b", "bucket").agg(best.alias("o")).select("mmsi_a", "mmsi_b", "bucket", "o.*")


def previous_occupied(points: DataFrame) -> DataFrame:
    """(bucket, before): for each occupied bucket the last earlier one, null for the first.

    Ordered within ranges of buckets; the first of a range takes the last of the range before, found among
    the ranges' ends.
    """
    occupied = points.select("bucket").distinct()
    part = F.floor(F.col("bucket") / RANGE_BUCKETS / 300)
    ranged = occupied.withColumn("part", part)
    ends = ranged.groupBy("part").agg(F.max("bucket").alias("last"))
    # a row for each range with any bucket: years of data give some hundreds
    before_part = ends.select(F.lead("part").over(Window.orderBy("part")).alias("part"), F.col("last").alias("last_before"))
    inside = ranged.withColumn("before", F.lag("bucket").over(Window.partitionBy("part").orderBy("bucket")))
    return inside.join(F.broadcast(before_part.where("part is not null")), "part", "left").select("bucket", F.coalesce("before", "last_before").alias("before"))


def as_pieces(pairs: DataFrame) -> DataFrame:
    """Observations as pieces of sessions: from ``since`` to ``bucket``, with sums and the positions at either end."""
    at = F.struct(F.col("latitude_a").alias("lat_a"), F.col("longitude_a").alias("lon_a"), F.col("latitude_b").alias("lat_b"), F.col("longitude_b").alias("lon_b"))
    return pairs.select("mmsi_a", "mmsi_b", "bucket", F.col("bucket").alias("since"), F.lit(1).cast("long").alias("observations"), F.col("km").alias("least_km"), F.col("km").alias("sum_km"), at.alias("start"), at.alias("end"))


def joined_pieces(pieces: DataFrame, occupied: DataFrame, config: Detection, strict_gap: bool = False) -> DataFrame:
    """Pieces put together to sessions, one piece each. ``occupied``: (bucket, before); a piece that comes first needs none.

    ``strict_gap``: the plain rule, a new session after any gap beyond the limit.
    """
    w = Window.partitionBy("mmsi_a", "mmsi_b").orderBy("bucket")
    # one row per occupied bucket, at most 288 a day: joined by equality, whichever way the planner picks
    seen = pieces.join(occupied, "bucket", "left").withColumn("previous", F.lag("bucket").over(w))
    reference: Column = F.col("bucket") if strict_gap else F.col("before")
    seen = seen.withColumn("session", F.sum(F.when(F.col("previous").isNull() | (reference - F.col("previous") > config.continuation_s), 1).otherwise(0)).over(w))
    return seen.groupBy("mmsi_a", "mmsi_b", "session").agg(
        F.max("bucket").alias("bucket"), F.min("since").alias("since"), F.sum("observations").alias("observations"), F.min("least_km").alias("least_km"), F.sum("sum_km").alias("sum_km"),
        F.min_by("start", "since").alias("start"), F.max_by("end", "bucket").alias("end"),
    )


def as_sessions(pieces: DataFrame) -> DataFrame:
    """The columns of a session; ``session`` is kept if it is there."""
    places = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("start", "end") for c in ("lat_a", "lon_a", "lat_b", "lon_b")]
    return pieces.select(
        "mmsi_a", "mmsi_b", *(c for c in ("session",) if c in pieces.columns), F.col("since").alias("start_epoch"), F.col("bucket").alias("end_epoch"),
        ((F.col("bucket") - F.col("since")) / 3600.0).alias("duration_hours"), "observations", F.col("least_km").alias("min_distance_km"), (F.col("sum_km") / F.col("observations")).alias("avg_distance_km"), *places,
    )


def meeting_sessions(pairs: DataFrame, points: DataFrame, config: Detection, strict_gap: bool = False) -> DataFrame:
    """All sessions with their duration, also those too short to be events."""
    return as_sessions(joined_pieces(as_pieces(pairs), previous_occupied(points), config, strict_gap))


def _occupied(points: DataFrame) -> DataFrame:
    return points.groupBy("bucket").agg(F.max("before").alias("before")) if "before" in points.columns else previous_occupied(points)


def sessions_of(points: DataFrame, config: Detection, exact_grid: bool = False, strict_gap: bool = False, least_h: float = 0.0, open_after: int | None = None) -> DataFrame:
    """The sessions of stored candidate points that last at least ``least_h``. ``points`` may bring the last occupied bucket before their own (``before``).

    ``open_after``: sessions that end after it are still open. Of these there are only rows of single vessels (``mmsi_b`` null): ``start_epoch`` is
    the earliest beginning, in the whole result, of the open sessions of ``mmsi_a``.
    """
    occupied = _occupied(points)
    if (bounds := ranges_for(points, config)) is not None:
        return crowded_sessions(points, bounds, config, exact_grid, strict_gap, least_h, open_after, occupied)
    sessions = as_sessions(joined_pieces(as_pieces(pair_observations(points, config, exact_grid)), occupied, config, strict_gap)).drop("session")
    if open_after is None:
        return sessions.where(F.col("duration_hours") >= least_h)
    kinds = dict(sessions.dtypes)
    row = lambda **given: F.struct(*(given.get(c, F.lit(None).cast(kinds[c])).alias(c) for c in sessions.columns))
    going = F.array(*(row(mmsi_a=F.col(m), start_epoch=F.col("start_epoch")) for m in ("mmsi_a", "mmsi_b")))
    told = sessions.where((F.col("duration_hours") >= least_h) | (F.col("end_epoch") > open_after))
    return told.select(F.inline(F.when(F.col("end_epoch") > open_after, going).otherwise(F.array(row(**{c: F.col(c) for c in sessions.columns})))))


def meetings(tracks: DataFrame, config: Detection | None = None, ports: DataFrame | None = None, exact_grid: bool = False, strict_gap: bool = False) -> DataFrame:
    """Events B: sessions of at least the least duration (inclusive)."""
    config = config or Detection()
    points = stored(meeting_points(tracks, config, ports), "points")  # few of the records, and read from several sides
    return sessions_of(points, config, exact_grid, strict_gap, config.meeting_h)


def sessions_with(points: DataFrame, vessel: int, config: Detection, exact_grid: bool = False, strict_gap: bool = False, least_h: float = 0.0) -> DataFrame:
    """Those of the sessions of ``sessions_of`` that one vessel takes part in: its points alone meet the others', so work grows with the points."""
    others, own = cell_sides(points.where(F.col("mmsi") != vessel), config, exact_grid)[0], cell_sides(points.where(F.col("mmsi") == vessel), config, exact_grid)[1]
    columns, first = ("mmsi", "latitude", "longitude", "seq"), F.col("mmsi_own") < F.col("mmsi")
    met = others.join(own.withColumnsRenamed({c: f"{c}_own" for c in columns}), ["bucket", "band", "to_x"])
    sides = [F.when(first if s == "a" else ~first, F.col(f"{c}_own")).otherwise(F.col(c)).alias(f"{c}_{s}") for s in ("a", "b") for c in columns]
    km = haversine_km(F.col("latitude_a"), F.col("longitude_a"), F.col("latitude_b"), F.col("longitude_b"))
    pairs = _closest(met.select("bucket", *sides).withColumn("km", km).where(F.col("km") <= config.meeting_km))
    return as_sessions(joined_pieces(as_pieces(pairs), _occupied(points), config, strict_gap)).drop("session").where(F.col("duration_hours") >= least_h)


def session_counts(points: DataFrame, config: Detection, exact_grid: bool = False, strict_gap: bool = False, least_h: float = 0.0, ends: crowds.Ends = None) -> DataFrame:
    """(mmsi, n) of vessels with any: how many of the sessions of ``sessions_of`` they have. In crowds these are counted where they are found, and never rows.

    ``ends``: only those that end from the first bucket on and before the second.
    """
    if (bounds := ranges_for(points, config, crowds.COUNTED)) is not None:
        return crowded_counts(points, _occupied(points), bounds, config, exact_grid, strict_gap, least_h, ends)
    low, high = ends or (None, None)
    sessions = sessions_of(points, config, exact_grid, strict_gap, least_h)
    return counted(sessions.where(F.lit(True) if low is None else F.col("end_epoch") >= low).where(F.lit(True) if high is None else F.col("end_epoch") < high))


def meeting_counts(tracks: DataFrame, config: Detection | None = None, ports: DataFrame | None = None, exact_grid: bool = False, strict_gap: bool = False) -> DataFrame:
    """(mmsi, n) of vessels with any: how many of the events of ``meetings`` they take part in."""
    config = config or Detection()
    return session_counts(stored(meeting_points(tracks, config, ports), "points"), config, exact_grid, strict_gap, config.meeting_h)


def counted(events: DataFrame) -> DataFrame:
    """(mmsi, n) of the vessels of given meetings; a busy vessel's are counted before they move."""
    return by_vessel(events).groupBy("mmsi").agg(F.count("*").alias("n"))


def by_vessel(events: DataFrame) -> DataFrame:
    """Each meeting once for either vessel (``mmsi``)."""
    return events.select(F.explode(F.array("mmsi_a", "mmsi_b")).alias("mmsi"), "*")
