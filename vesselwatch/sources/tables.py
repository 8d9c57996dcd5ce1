"""Reading position reports, port catalogues and land masks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselwatch.functions import clean

#: Fixed values of the input format: header names and ours.
COLUMNS = {
    "# Timestamp": "raw_time",
    "Type of mobile": "raw_type",
    "MMSI": "raw_mmsi",
    "Latitude": "raw_latitude",
    "Longitude": "raw_longitude",
    "SOG": "raw_sog",
    "Draught": "raw_draught",
}
PORT_SCHEMA = "port_name string, country string, latitude double, longitude double, radius_km double"


#: A local path has one or three slashes.
_AUTHORITY = "^file:/+"


def header_column(columns: Sequence[str], name: str) -> str | None:
    """The column of a header name: of repeated headers, which Spark numbers by their place, the last one."""
    numbered = [c for k, c in enumerate(columns) if c == f"{name}{k}"]
    return name if name in columns else numbered[-1] if len(numbered) > 1 else None


def read_raw(spark: SparkSession, paths: str | Sequence[str], encoding: str = "utf-8", multi_line: bool = False) -> DataFrame:
    """Seven text columns, ``file_no``, ``file_block`` and ``row_no`` of CSV files, in argument order.

    Headers are bound by name; paths of the same header are one scan, whatever their number, so column orders
    may differ. Files without any line are skipped; a path without a needed column raises ValueError naming
    what is missing. A row is placed by the number of its path, the start of its block in the file and its
    place among the rows read.
    """
    options = {"header": True, "inferSchema": False, "escape": '"', "encoding": encoding, "multiLine": multi_line}
    given = [paths] if isinstance(paths, str) else list(paths)
    with ThreadPoolExecutor(16) as pool:  # a header needs one small job
        headers = list(pool.map(lambda path: tuple(spark.read.options(**options).csv(path).columns), given))
    groups: dict[tuple[str, ...], list[int]] = {}
    for number, (path, columns) in enumerate(zip(given, headers, strict=True)):
        if missing := sorted(n for n in COLUMNS if header_column(columns, n) is None) if columns else []:
            raise ValueError(f"{path}: missing columns: {', '.join(missing)}")
        if columns:
            groups.setdefault(columns, []).append(number)
    if not groups:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS.values()) + ", file_no int, file_block long, row_no long")
    frames = []
    for columns, numbers in groups.items():
        df = spark.read.options(**options).schema(", ".join(f"`{c.replace('`', '``')}` string" for c in columns)).csv([given[k] for k in numbers])
        bound = [F.col(f"`{header_column(columns, n)}`").alias(ours) for n, ours in COLUMNS.items()]
        df = df.select(*bound, F.regexp_replace("_metadata.file_path", _AUTHORITY, "file:/").alias("__file"), F.col("_metadata.file_block_start").alias("file_block"), F.monotonically_increasing_id().alias("row_no"))
        if len(numbers) == 1:
            df = df.withColumn("file_no", F.lit(numbers[0]))
        else:  # the argument list's files, not the data
            files = [(re.sub(_AUTHORITY, "file:/", f), k) for k in numbers for f in spark.read.text(given[k]).inputFiles()]
            df = df.join(F.broadcast(spark.createDataFrame(files, "__file string, file_no int").dropDuplicates(["__file"])), "__file")
        frames.append(df.select(*COLUMNS.values(), "file_no", "file_block", "row_no"))
    return reduce(DataFrame.unionByName, frames)


def typed(raw: DataFrame) -> DataFrame:
    """Raw rows with typed columns beside them; nothing is dropped.

    The parsed values of a row are generated as one struct: what follows refers to them and doesn't parse again.
    """
    parsed = F.struct(
        clean.parse_time(F.col("raw_time")).alias("ts"),
        clean.parse_int(F.col("raw_mmsi")).alias("mmsi"),
        *(clean.parse_float(F.col(f"raw_{c}")).alias(c) for c in ("latitude", "longitude", "sog", "draught")),
    )
    return raw.select("*", F.inline(F.array(parsed)))


def reject_reason(raw_type: str = "raw_type"):
    """The first reason a typed row is rejected for, or null: type, time, mmsi, latitude, longitude, origin."""
    lat, lon = F.col("latitude"), F.col("longitude")
    return (
        F.when(~clean.valid_mobile_type(F.col(raw_type)), "type")
        .when(F.col("ts").isNull(), "time")
        .when(~clean.valid_mmsi(F.col("mmsi")), "mmsi")
        .when(~clean.valid_latitude(lat), "latitude")
        .when(~clean.valid_longitude(lon), "longitude")
        .when(clean.at_origin(lat, lon), "origin")
    )


def valid_records(raw: DataFrame) -> DataFrame:
    """(mmsi, ts, seq, latitude, longitude, sog, draught) of the rows that pass all checks.

    ``seq`` orders records of one time: file, block, row.
    """
    order = F.struct(*(c for c in ("file_no", "file_block", "row_no") if c in raw.columns))
    return typed(raw.where(clean.valid_mobile_type(F.col("raw_type")))).where(reject_reason().isNull()).select("mmsi", "ts", order.alias("seq"), "latitude", "longitude", "sog", "draught")


def read_ports(spark: SparkSession, path: str) -> DataFrame:
    """Port circles with their place in the file (``port_no``); a number that can't be read raises."""
    text = spark.read.option("header", True).csv(path)
    columns = [F.trim(F.col(c)).cast(t).alias(c) for c, t in (x.split() for x in PORT_SCHEMA.split(", "))]
    return text.select(F.monotonically_increasing_id().alias("port_no"), *columns)


def land_from_rings(spark: SparkSession, polygons: Sequence[Sequence[Sequence[tuple[float, float]]]]) -> DataFrame:
    """A mask of polygons given as rings of (longitude, latitude); further rings are holes."""
    rows = []
    for number, rings in enumerate(polygons):
        edges = [(float(a[0]), float(a[1]), float(b[0]), float(b[1])) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) if tuple(a) != tuple(b)]
        rows.append((number, edges))
    return spark.createDataFrame(rows, "polygon_id long, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")


def read_land(spark: SparkSession, path: str) -> DataFrame:
    """A mask from GeoJSON: a collection of features, or a feature or geometry on each line; polygons and multi-polygons.

    Also read are lines of {"polygon_id": 1, "edges": [{"x1":..., "y1":..., "x2":..., "y2":...}]}. Other
    geometries are ignored.
    """
    edges, geometry = "array<struct<x1:double,y1:double,x2:double,y2:double>>", "struct<type:string,coordinates:string>"
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    each = F.forall(lines, lambda x: F.trim(x).startswith("{") & F.trim(x).endswith("}"))  # else one document over several lines
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.when(each, lines).otherwise(F.array("value"))).alias("value"))
    parsed = F.from_json("value", f"type string, coordinates string, geometry {geometry}, features array<struct<geometry:{geometry}>>, edges {edges}")
    shapes = lines.select(parsed.alias("d")).select(
        "d.edges", F.explode_outer(F.coalesce(F.transform("d.features", lambda f: f["geometry"]), F.array(F.coalesce("d.geometry", F.struct("d.type", "d.coordinates"))))).alias("g")
    )
    rings = "array<array<array<double>>>"
    polygons = F.when(F.col("g.type") == "Polygon", F.array(F.from_json("g.coordinates", rings))).when(F.col("g.type") == "MultiPolygon", F.from_json("g.coordinates", f"array<{rings}>"))
    ready = shapes.where("edges is not null").select("edges")
    made = shapes.where("edges is null").select(F.explode(polygons).alias("rings")).select(F.flatten(F.transform("rings", _ring_edges)).alias("edges"))
    return ready.unionByName(made).select(F.monotonically_increasing_id().alias("polygon_id"), "edges")


def _ring_edges(ring: Column) -> Column:
    """Edges between neighbouring points of a ring, closed if it isn't."""
    following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    edge = lambda p, q: F.struct(p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2"))
    return F.filter(F.zip_with(ring, following, edge), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
