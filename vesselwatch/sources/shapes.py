"""Land masks from shapefiles, in the form of ``tables.read_land``."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselwatch.session import ship_package

#: Fixed values of the format: the file code, the header's size, and the types of polygons (plain, with heights, with measures).
FILE_CODE, HEADER, POLYGONS = 9994, 100, (5, 15, 25)
EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def polygon_edges(data: bytes) -> Iterator[np.ndarray]:
    """Edges (x1, y1, x2, y2) of each polygon record, all its rings together: holes follow from the even-odd rule. Other shapes are passed over."""
    if len(data) < HEADER or struct.unpack_from(">i", data)[0] != FILE_CODE:
        raise ValueError("not a shapefile")
    at = HEADER
    while at + 8 <= len(data):
        size = 2 * struct.unpack_from(">i", data, at + 4)[0]
        at += 8
        if at + size > len(data):
            raise ValueError("the shapefile ends within a record")
        if size >= 44 and struct.unpack_from("<i", data, at)[0] in POLYGONS:
            n_parts, n_points = struct.unpack_from("<ii", data, at + 36)
            starts = np.frombuffer(data, "<i4", n_parts, at + 44)
            points = np.frombuffer(data, "<f8", 2 * n_points, at + 44 + 4 * n_parts).reshape(-1, 2)
            rings = [np.vstack([ring, ring[:1]]) for ring in np.split(points, starts[1:]) if len(ring)]
            edges = np.vstack([np.hstack([ring[:-1], ring[1:]]) for ring in rings] or [np.empty((0, 4))])
            yield edges[(edges[:, :2] != edges[:, 2:]).any(axis=1)]
        at += size


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            for edges in polygon_edges(content.as_py()):
                fields = pa.StructArray.from_arrays([pa.array(edges[:, k]) for k in range(4)], ["x1", "y1", "x2", "y2"])
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(edges)], pa.int32()), fields)], ["edges"])


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """A mask from the ``.shp`` files at ``path`` (a file, folder or pattern), in any store that Spark reads; a file is a task, its polygons are rows.

    The format holds less than 2 GB a file; larger masks come in several.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[sS][hH][pP]").load(path).select("content")
    return files.mapInArrow(_parse, f"edges {EDGES}").select(F.monotonically_increasing_id().alias("polygon_id"), "edges")
