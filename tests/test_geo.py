"""Catalogues: nearest ports against all ports, land masks from their formats, large polygons."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from vesselwatch.functions.geo import land_by_cell, nearest_port, with_on_land
from vesselwatch.sources import tables


def _km(a, b, c, d):
    a, b, c, d = map(np.radians, (a, b, c, d))
    x = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * 6371 * np.arctan2(np.sqrt(x), np.sqrt(1 - x))


def test_nearest_port_is_that_of_all(spark):
    rng = np.random.default_rng(1)
    ports = [(k, f"p{k}", float(la), float(lo)) for k, (la, lo) in enumerate(zip(rng.uniform(-89, 89, 300), rng.uniform(-180, 180, 300), strict=True))]
    ports += [(300, "same", 10.0, 20.0), (301, "same again", 10.0, 20.0), (302, "north", 89.9, 0.0)]
    points = [(k, float(la), float(lo)) for k, (la, lo) in enumerate(zip(rng.uniform(-90, 90, 400), rng.uniform(-180, 180, 400), strict=True))]
    points += [(900, 10.1, 20.1), (901, 90.0, 180.0), (902, -90.0, -180.0), (903, 0.0, 180.0), (904, None, 1.0)]
    df = spark.createDataFrame(points, "seq int, latitude double, longitude double")
    catalogue = spark.createDataFrame(ports, "port_no int, port_name string, latitude double, longitude double")
    got = {r["seq"]: (r["port_name"], r["distance_km"]) for r in nearest_port(df, catalogue, ["seq"]).collect()}
    lat, lon = np.array([p[2] for p in ports]), np.array([p[3] for p in ports])
    assert set(got) == {p[0] for p in points if p[1] is not None}
    for k, la, lo in points[:-1]:
        km = _km(la, lo, lat, lon)
        assert got[k][1] == pytest.approx(km.min(), abs=1e-6)
        assert got[k][0] == ports[int(km.argmin())][1] or km.min() == pytest.approx(np.partition(km, 1)[1])
    assert got[900][0] == "same"
    assert nearest_port(df, catalogue.limit(0), ["seq"]).count() == 0


SQUARE, HOLE = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6]]


@pytest.mark.parametrize(
    "text",
    [
        json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"a": [1]}, "geometry": {"type": "Polygon", "coordinates": [SQUARE, HOLE]}}, {"type": "Feature", "geometry": None}]}, indent=1),
        json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [SQUARE, HOLE]}}) + "\n\n" + json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}),
        json.dumps({"type": "MultiPolygon", "coordinates": [[SQUARE, HOLE], [[[20, 20], [21, 20], [21, 21]]]]}),
        json.dumps({"polygon_id": 1, "edges": [{"x1": float(a[0]), "y1": float(a[1]), "x2": float(b[0]), "y2": float(b[1])} for r in (SQUARE, [*HOLE, HOLE[0]]) for a, b in zip(r, r[1:])]}),  # noqa: B905
    ],
)
def test_land_formats(spark, tmp_path, text):
    (tmp_path / "land.json").write_text(text)
    cells = land_by_cell(tables.read_land(spark, str(tmp_path / "land.json")))
    points = [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 11.0, 1.0), (4, 3.9, 5.0), (5, 0.0, 5.0), (6, 9.99, 9.99), (7, -1.0, 5.0)]
    df = spark.createDataFrame(points, "k int, latitude double, longitude double")
    got = {r["k"]: r["land"] for r in with_on_land(df, cells, "latitude", "longitude", "land", F.lit(True)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True, 7: False}


def test_a_large_polygon_is_cut_into_its_cells(spark):
    n = 20_000
    ring = [(150 * math.cos(2 * math.pi * k / n), 60 * math.sin(2 * math.pi * k / n) + (k % 2) * 0.001) for k in range(n)]
    land = tables.land_from_rings(spark, [[ring]])
    cells = land_by_cell(land)
    held, most = cells.select(F.aggregate("parts", F.lit(0), lambda s, p: s + F.size(p["edges"])).alias("n")).agg(F.sum("n"), F.max("n")).first()
    assert held < 60 * n and most < 2000
    rng = np.random.default_rng(2)
    points = [(k, float(la), float(lo)) for k, (la, lo) in enumerate(zip(rng.uniform(-80, 80, 500), rng.uniform(-180, 180, 500), strict=True))]
    df = spark.createDataFrame(points, "k int, latitude double, longitude double")
    for r in with_on_land(df, cells, "latitude", "longitude", "land", F.lit(True)).collect():
        inside = (r["longitude"] / 150) ** 2 + (r["latitude"] / 60) ** 2
        assert abs(inside - 1) < 0.01 or r["land"] == (inside < 1)


def test_headers_are_bound_by_name(spark, tmp_path):
    head = "# Timestamp,Type of mobile,MMSI,Latitude,Longitude,SOG,Draught"
    row = "01/09/2025 12:34:56,Class A,22345678{},10.5,20.5,7.2,8.5\n"
    for k in range(4):
        (tmp_path / f"{k}.csv").write_text(f"{head}\n{row.format(k)}")
    (tmp_path / "twice.csv").write_text(f"{head},Latitude\n{row.format(5).strip()},11.5\n")
    (tmp_path / "odd.csv").write_text(f"{head.replace('Latitude', 'Latitude3')}\n{row.format(6)}")
    names = ["3", "1", "twice", "0", "2"]
    raw = tables.read_raw(spark, [str(tmp_path / f"{k}.csv") for k in names])
    got = [(r["file_no"], r["raw_mmsi"][-1], r["raw_latitude"]) for r in raw.orderBy("file_no").collect()]
    assert got == [(0, "3", "10.5"), (1, "1", "10.5"), (2, "5", "11.5"), (3, "0", "10.5"), (4, "2", "10.5")]
    assert raw._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    with pytest.raises(ValueError, match="missing columns: Latitude$"):
        tables.read_raw(spark, str(tmp_path / "odd.csv"))
