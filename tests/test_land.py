"""Land covers against the even-odd rule over all edges; masks from shapefiles."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F
from vesselwatch.functions.geo import land_by_cell, with_on_land
from vesselwatch.sources.shapes import polygon_edges, read_shapefile
from vesselwatch.sources.tables import land_from_rings, read_land


def _star(rng, x, y, r, n):
    return [(x + r * (1 + rng.uniform(-0.5, 0.5)) * math.cos(2 * math.pi * k / n), y + r * 0.6 * (1 + rng.uniform(-0.5, 0.5)) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def _polygons():
    rng = random.Random(1)
    squares = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(0.5, 0.5), (0.75, 0.5), (0.75, 1.0), (0.5, 1.0)]]  # along the borders of cells
    return [[_star(rng, 10, 50, 8, 200), _star(rng, 10, 50, 1.5, 40)], [_star(rng, 178, 10, 6, 60)], [_star(rng, -179, -20, 5, 30)], squares, [[(1.0, 1.0), (3.0, 1.0), (3.0, 3.0)]], [_star(rng, 30, -40, 0.1, 7)]]


def _inside(polygons, lon, lat):
    for rings in polygons:
        for x in (lon, lon + 360, lon - 360):
            crossed, touching = 0, False
            for ring in rings:
                for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
                    crossed += (y1 > lat) != (y2 > lat) and x < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
                    touching |= (x2 - x1) * (lat - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= lat <= max(y1, y2)
            if crossed % 2 and not touching:
                return True
    return False


def _points():
    rng = random.Random(2)
    points = [(rng.uniform(0, 22), rng.uniform(43, 57)) for _ in range(1500)] + [(rng.choice([-1, 1]) * rng.uniform(170, 180), rng.uniform(-30, 20)) for _ in range(1000)]
    points += [(k * 0.125, j * 0.125) for k in range(-2, 28) for j in range(-2, 28)] + [(30 + rng.uniform(-0.15, 0.15), -40 + rng.uniform(-0.15, 0.15)) for _ in range(200)]
    return points + [(-180.0, 10.0), (180.0, 10.0), (0.0, 90.0), (0.0, -90.0)]


def test_cover_equals_all_edges(spark):
    polygons, points = _polygons(), _points()
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k long, lon double, lat double")
    cells = land_by_cell(land_from_rings(spark, polygons))
    got = {r["k"]: r["l"] for r in with_on_land(df, cells, "lat", "lon", "l", F.lit(True)).collect()}
    assert [k for k, p in enumerate(points) if got[k] != _inside(polygons, *p)] == []
    assert 300 < sum(got.values()) < len(points) - 300
    # cells within the coast need no edges, and border cells hold few
    assert cells.where("whole").count() > 1000
    assert cells.select(F.max(F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p["edges"])))).first()[0] < 40


def _shp(shapes, kind=5):
    """A shapefile's bytes; a shape is a list of closed rings, or None."""
    records = b""
    for number, rings in enumerate(shapes, 1):
        if rings is None:
            body = struct.pack("<i", 0)
        else:
            points = [p for ring in rings for p in ring]
            starts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
            xs, ys = [p[0] for p in points] or [0], [p[1] for p in points] or [0]
            body = struct.pack("<i4d2i", kind, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        records += struct.pack(">2i", number, len(body) // 2) + body
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8) + records


def test_shapefile_equals_geojson(spark, tmp_path):
    polygons = [[[*ring, ring[0]] for ring in rings] for rings in _polygons()]
    (tmp_path / "shp").mkdir()
    (tmp_path / "shp" / "a.shp").write_bytes(_shp([*polygons[:3], None]))
    (tmp_path / "shp" / "b.SHP").write_bytes(_shp(polygons[3:], 15))
    (tmp_path / "shp" / "a.dbf").write_bytes(b"other data")
    (tmp_path / "land.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": p}} for p in polygons]}))
    edges = lambda land: sorted(sorted(map(tuple, r["edges"])) for r in land.collect())
    assert edges(read_shapefile(spark, str(tmp_path / "shp"))) == edges(read_land(spark, str(tmp_path / "land.json")))


def test_broken_shapefiles():
    whole = _shp([[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]])
    assert len(list(polygon_edges(whole))[0]) == 3
    for broken in (b"", whole[:50], b"x" * 200, whole[:-8]):
        with pytest.raises(ValueError, match="shapefile"):
            list(polygon_edges(broken))
    assert list(polygon_edges(_shp([]))) == []
