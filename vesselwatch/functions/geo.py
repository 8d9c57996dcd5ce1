"""Distances, port proximity and land tests. Catalogues are looked up by grid cell, an equi-join."""

from __future__ import annotations

import math
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EARTH_RADIUS_KM = 6371.0
KM_PER_NAUTICAL_MILE = 1.852
#: Degrees of the cells of the port catalogue and of the land mask.
PORT_CELL, LAND_CELL = 0.25, 0.25
#: Where in a land cell its reference point lies, as parts of its sides: not on lines that masks are likely to have corners on.
REFERENCE_X, REFERENCE_Y = 0.3141592653589793, 0.5772156649015329
#: Kilometres of a degree of latitude, rounded down so that cells cover a radius.
KM_PER_DEGREE = 111.0
#: Ports or edges in a look-up table that is broadcast, at most (some 40 bytes each).
BROADCAST_ROWS = 500_000
#: Degrees of the cells in which candidates for the nearest port are narrowed down, from coarse to fine.
NEAREST_CELLS = (8.0, 1.0, 0.25)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_km_of(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """The same of arrays."""
    half_lat, half_lon = np.radians(lat2 - lat1) / 2, np.radians(lon2 - lon1) / 2
    a = np.sin(half_lat) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(half_lon) ** 2
    a = np.clip(a, 0.0, 1.0)
    return 2 * EARTH_RADIUS_KM * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def nautical_miles(km: Column) -> Column:
    return km / KM_PER_NAUTICAL_MILE


def speed_knots(km: Column, hours: Column) -> Column:
    """Null for no time or a negative one."""
    return F.when(hours > 0, nautical_miles(km) / hours)


def _cell(degrees: Column, size: float) -> Column:
    return F.floor(degrees / size)


_checked: WeakKeyDictionary[DataFrame, dict[tuple, bool]] = WeakKeyDictionary()


def _small(catalogue: DataFrame, cells: DataFrame, rows: DataFrame, *key: float) -> DataFrame:
    """Broadcast the cells of a catalogue if all they hold, ``rows``, is little (counted once for a catalogue, and no further); otherwise the join shuffles."""
    known = _checked.setdefault(catalogue, {})
    if key not in known:
        known[key] = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(cells) if known[key] else cells


def ports_by_cell(ports: DataFrame, minimum_radius_km: float) -> DataFrame:
    """(cell_y, cell_x, ports): the ports whose circle may reach into a cell. Longitudes wrap around."""
    width = round(360 / PORT_CELL)
    reach = F.greatest(F.col("radius_km"), F.lit(float(minimum_radius_km))) * 1.01 + 0.01
    d_lat = reach / KM_PER_DEGREE
    highest = F.least(F.lit(89.9), F.abs(F.col("latitude")) + d_lat)
    d_lon = F.least(F.lit(180.0), d_lat / F.cos(F.radians(highest)))
    row = F.struct("latitude", "longitude", reach.alias("reach"), F.greatest(F.col("radius_km"), F.lit(float(minimum_radius_km))).alias("radius_km"))
    xs = F.array_distinct(F.transform(F.sequence(_cell(F.col("longitude") - d_lon, PORT_CELL), _cell(F.col("longitude") + d_lon, PORT_CELL)), lambda x: F.pmod(x, F.lit(width))))
    cells = ports.select(row.alias("port"), F.explode(F.sequence(_cell(F.col("latitude") - d_lat, PORT_CELL), _cell(F.col("latitude") + d_lat, PORT_CELL))).alias("cell_y"), xs.alias("xs"))
    cells = cells.select("port", "cell_y", F.explode("xs").alias("cell_x"))
    return _small(ports, cells.groupBy("cell_y", "cell_x").agg(F.collect_list("port").alias("ports")), cells, float(minimum_radius_km))


def with_near_port(df: DataFrame, cells: DataFrame, lat: str, lon: str, out: str, only: Column | None = None) -> DataFrame:
    """``df`` with the boolean ``out``: within the radius of any port (inclusive). ``only``: rows to look up, others are false."""
    width = round(360 / PORT_CELL)
    y, x = _cell(F.col(lat), PORT_CELL), F.pmod(_cell(F.col(lon), PORT_CELL), F.lit(width))
    if only is not None:
        y, x = F.when(only, y), F.when(only, x)
    found = cells.select(F.col("cell_y").alias("__y"), F.col("cell_x").alias("__x"), F.col("ports").alias("__ports"))
    near = F.exists("__ports", lambda p: haversine_km(F.col(lat), F.col(lon), p["latitude"], p["longitude"]) <= p["radius_km"])
    joined = df.withColumns({"__cy": y, "__cx": x}).join(found, (F.col("__cy") == F.col("__y")) & (F.col("__cx") == F.col("__x")), "left")
    return joined.withColumn(out, F.coalesce(near, F.lit(False))).drop("__cy", "__cx", "__y", "__x", "__ports")


def nearest_port(points: DataFrame, ports: DataFrame, key: list[str], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """``key`` columns with the nearest port's name and distance; ties: the first in the catalogue. No ports: no rows.

    Candidates are narrowed down by cells of the earth, from coarse to fine: the port nearest to a point lies
    at most a cell's diameter further from the cell's centre than the centre's own nearest port. Only cells
    with points are followed; a fine cell has one row, whatever the number of points in it.
    """
    located = points.select(*key, F.col(lat).alias("__lat"), F.col(lon).alias("__lon")).where("__lat is not null and __lon is not null")
    finest = NEAREST_CELLS[-1]
    own = F.struct(_cell(F.col("__lat"), finest).alias("y"), _cell(F.col("__lon"), finest).alias("x"))
    cells = located.select(own.alias("cell")).distinct()  # at most one for each cell of the earth
    parent = lambda size: F.struct(_cell((F.col("cell.y") + 0.5) * finest, size).alias("y"), _cell((F.col("cell.x") + 0.5) * finest, size).alias("x"))
    every = ports.select("port_no", "port_name", F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon")).where("p_lat is not null and p_lon is not null")
    near, above = every.withColumn("up", F.lit(0)), F.lit(0)
    for size in NEAREST_CELLS:
        here = cells.select(parent(size).alias("at"), above.alias("up")).distinct()
        # the coarsest cells are about a thousand: ports meet all that hold points
        met = near.join(F.broadcast(here) if size == NEAREST_CELLS[0] else here, "up")
        away = haversine_km((F.col("at.y") + 0.5) * size, (F.col("at.x") + 0.5) * size, F.col("p_lat"), F.col("p_lon"))
        met = met.withColumn("away", away)
        bounds = met.groupBy("at").agg((F.min("away") + size * 1.4143 * degrees_to_km(1.0) + 0.01).alias("bound"))
        near = met.join(bounds, "at").where("away <= bound").select("port_no", "port_name", "p_lat", "p_lon", F.col("at").alias("up"))
        above = parent(size)
    choice = near.groupBy(F.col("up").alias("cell")).agg(F.collect_list(F.struct("port_no", "port_name", "p_lat", "p_lon")).alias("ports"))
    ranked = F.transform("ports", lambda p: F.struct(haversine_km(F.col("__lat"), F.col("__lon"), p["p_lat"], p["p_lon"]).alias("km"), p["port_no"].alias("no"), p["port_name"].alias("name")))
    joined = located.withColumn("cell", own).join(choice, "cell").withColumn("best", F.array_min(ranked))
    return joined.select(*key, F.col("best.name").alias("port_name"), F.col("best.km").alias("distance_km"))


def land_by_cell(land: DataFrame) -> DataFrame:
    """(land_y, land_x, whole, parts): a cover of the mask by cells; cells without land are left out.

    ``land``: polygon_id, edges array<struct<x1,y1,x2,y2>> in degrees (all rings, holes too); longitudes may go beyond 180. A cell that no
    edge of a polygon touches lies inside or outside as a whole (``whole``: inside some polygon). A border cell has a part for each polygon: the
    edges in it, and whether its reference point is inside. So a test looks at a cell's own edges only, whatever
    the polygon's size.
    """
    edge = land.select("edges", F.monotonically_increasing_id().alias("polygon"))
    lowest, highest = F.array_min(F.transform("edges", lambda e: F.least(e["x1"], e["x2"]))), F.array_max(F.transform("edges", lambda e: F.greatest(e["x1"], e["x2"])))
    shifts = F.concat(F.array(F.lit(0.0)), F.when(highest > 180, F.array(F.lit(-360.0))).otherwise(F.array()), F.when(lowest < -180, F.array(F.lit(360.0))).otherwise(F.array()))
    edge = edge.select("polygon", "edges", F.explode(shifts).alias("shift")).select("polygon", "shift", F.explode("edges").alias("e"))  # in this order: an edge's row doesn't carry all edges
    moved = F.struct((F.col("e.x1") + F.col("shift")).alias("x1"), F.col("e.y1").alias("y1"), (F.col("e.x2") + F.col("shift")).alias("x2"), F.col("e.y2").alias("y2"))
    edge = edge.select(F.struct("polygon", "shift").alias("polygon"), moved.alias("e"))
    banded = edge.select("polygon", "e", F.explode(F.sequence(_cell(F.least("e.y1", "e.y2"), LAND_CELL), _cell(F.greatest("e.y1", "e.y2"), LAND_CELL))).alias("land_y"))
    # the part of the edge in the band, a little wider than it is
    level, slack = F.col("e.y1") == F.col("e.y2"), 1e-9
    at = lambda y: _x_at(F.col("e"), F.least(F.greatest(y, F.least("e.y1", "e.y2")), F.greatest("e.y1", "e.y2")))
    ends = [F.when(level, F.col("e.x1")).otherwise(at(F.col("land_y") * LAND_CELL)), F.when(level, F.col("e.x2")).otherwise(at((F.col("land_y") + 1) * LAND_CELL))]
    middle = (F.col("land_y") + REFERENCE_Y) * LAND_CELL
    crossing = F.when((F.col("e.y1") > middle) != (F.col("e.y2") > middle), _x_at(F.col("e"), middle))
    banded = banded.select("polygon", "e", "land_y", _cell(F.least(*ends) - slack, LAND_CELL).alias("x0"), _cell(F.greatest(*ends) + slack, LAND_CELL).alias("x1"), crossing.alias("crossing"))
    touched = banded.select("polygon", "land_y", "e", F.explode(F.sequence("x0", "x1")).alias("land_x"))
    border = touched.groupBy("polygon", "land_y", "land_x").agg(F.collect_list("e").alias("edges"))
    # a running count of the crossings of the band's reference latitude: at each border cell's western side, and at its reference point
    none = border.schema["edges"].dataType
    mark = lambda at, kind, edges: border.select("polygon", "land_y", at.alias("at"), F.lit(kind).alias("kind"), "land_x", edges.alias("edges"))
    marks = mark(F.col("land_x") * LAND_CELL, 0, F.lit(None).cast(none)).unionByName(mark((F.col("land_x") + REFERENCE_X) * LAND_CELL, 2, F.col("edges")))
    crossings = banded.where("crossing is not null").select("polygon", "land_y", F.col("crossing").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("land_x"), F.lit(None).cast(none).alias("edges"))
    band = Window.partitionBy("polygon", "land_y")
    counted = marks.unionByName(crossings).withColumn("inside", F.count_if(F.col("kind") == 1).over(band.orderBy("at", "kind")) % 2 == 1).where("kind <> 1")
    cells = counted.where("kind = 0").withColumn("before", F.lag("land_x").over(band.orderBy("land_x")))
    between = cells.where("inside and land_x > before + 1").select("land_y", F.explode(F.sequence(F.col("before") + 1, F.col("land_x") - 1)).alias("land_x"), F.lit(True).alias("whole"), F.lit(None).cast("struct<inside:boolean,edges:array<struct<x1:double,y1:double,x2:double,y2:double>>>").alias("part"))
    rows = between.unionByName(counted.where("kind = 2").select("land_y", "land_x", F.lit(False).alias("whole"), F.struct("inside", "edges").alias("part")))
    # collect_list leaves out the nulls of whole cells
    return _small(land, rows.groupBy("land_y", "land_x").agg(F.max("whole").alias("whole"), F.collect_list("part").alias("parts")), touched, 0.0)


def _x_at(e: Column, y: Column) -> Column:
    """Longitude of an edge that isn't level at a latitude."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]


def _inside(lon: Column, lat: Column, part: Column, west: Column, middle: Column) -> Column:
    """Even-odd rule along a way from the reference point: up or down, then east or west. A point on an edge is outside.

    The way lies an infinitely small step east of that point and a larger one north of the tested point's latitude, so it passes no corner of the mask.
    """

    def upward(e: Column) -> Column:
        y = (e["y2"] - e["y1"]) * (west - e["x1"]) / F.nullif(e["x2"] - e["x1"], F.lit(0.0)) + e["y1"]
        return F.when((e["x1"] > west) != (e["x2"] > west), (y > lat) != (y > middle)).otherwise(False)

    def eastward(e: Column) -> Column:
        x = _x_at(e, lat)
        return F.when((e["y1"] > lat) != (e["y2"] > lat), ((x > west) | ((x == west) & ((e["x2"] > e["x1"]) == (e["y2"] > e["y1"])) & (e["x1"] != e["x2"]))) != (x > lon)).otherwise(False)

    def touching(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (lat - e["y1"]) - (e["y2"] - e["y1"]) * (lon - e["x1"])
        return (cross == 0) & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    crossed = F.size(F.filter(part["edges"], upward)) + F.size(F.filter(part["edges"], eastward))
    return (part["inside"] != (crossed % 2 == 1)) & ~F.exists(part["edges"], touching)


def with_on_land(df: DataFrame, cells: DataFrame | None, lat: str, lon: str, out: str, only: Column) -> DataFrame:
    """``df`` with the boolean ``out``: null without a mask or outside ``only``."""
    if cells is None:
        return df.withColumn(out, F.lit(None).cast("boolean"))
    found = cells.select(F.col("land_y").alias("__y"), F.col("land_x").alias("__x"), F.col("whole").alias("__whole"), F.col("parts").alias("__land"))
    y, x = F.when(only, _cell(F.col(lat), LAND_CELL)), F.when(only, _cell(F.col(lon), LAND_CELL))
    inside = F.col("__whole") | F.exists("__land", lambda part: _inside(F.col(lon), F.col(lat), part, (F.col("__x") + REFERENCE_X) * LAND_CELL, (F.col("__y") + REFERENCE_Y) * LAND_CELL))
    joined = df.withColumns({"__cy": y, "__cx": x}).join(found, (F.col("__cy") == F.col("__y")) & (F.col("__cx") == F.col("__x")), "left")
    return joined.withColumn(out, F.when(only, F.coalesce(inside, F.lit(False)))).drop("__cy", "__cx", "__y", "__x", "__whole", "__land")


def grid_degrees(max_km: float) -> float:
    """Degrees of a cell whose neighbours hold all points within ``max_km`` (at the equator)."""
    return max_km / KM_PER_DEGREE * 1.2


def degrees_to_km(degrees: float) -> float:
    return degrees * math.pi * EARTH_RADIUS_KM / 180
