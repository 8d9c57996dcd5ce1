"""Lists of sessions and pairs of crowds: few copies of points, and the same as by joins."""

import random

import pytest
from vesselwatch.config import Detection
from vesselwatch.operators import crowds
from vesselwatch.operators import meetings as meet

CONFIG = Detection()


def crowd(spark, lat, lon, vessels=40, buckets=60, seed=5):
    """Vessels in and out of a crowd of some cells, one point in a bucket at most."""
    rng = random.Random(seed)
    rows = [(m, 300 * t, lat + rng.random() * 0.012, (lon + rng.random() * 0.02 + 180) % 360 - 180) for m in range(vessels) for t in range(0, buckets) if rng.random() < 0.5]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "mmsi long, bucket long, latitude double, longitude double, seq long")


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_copies_of_points_do_not_grow_with_pairs(spark, monkeypatch):
    monkeypatch.setattr(crowds, "LEAST_PAIRS", 0)
    monkeypatch.setattr(crowds, "CANDIDATES", 500)
    points = spark.range(60 * 40).selectExpr("id div 40 as mmsi", "id % 40 * 300 as bucket", "10D as latitude", "20D as longitude", "id as seq")
    assert 0 < len(crowds.ranges_for(points, CONFIG)) < 8  # by pairs: 24
    assert meet.sessions_of(points, CONFIG).count() == 60 * 59 // 2


@pytest.mark.parametrize("place", [(0.0, 0.0, False, False), (-33.0, 151.0, False, True), (64.0, 179.99, True, False)])
@pytest.mark.parametrize("limits", [{}, {"least_h": 0.5}, {"least_h": 0.5, "open_after": 15000}])
def test_sessions_by_bits_equal_the_joins(spark, monkeypatch, place, limits):
    lat, lon, exact, strict = place
    points = crowd(spark, lat, lon)
    by_points = []
    monkeypatch.setattr(crowds, "_PAIRS_OUT", 50)
    for bounds in (None, [], [11, 12, 30]):
        monkeypatch.setattr(meet, "ranges_for", lambda *a, b=bounds: b)
        told = meet.sessions_of(points, CONFIG, exact, strict, **limits)
        by_points.append((rows(told.where("mmsi_b is not null")), sorted(map(tuple, told.where("mmsi_b is null").groupBy("mmsi_a").agg({"start_epoch": "min"}).collect()))))
    assert by_points[0] == by_points[1] == by_points[2] and len(by_points[0][0]) > 20
    assert bool(by_points[0][1]) == ("open_after" in limits)


@pytest.mark.parametrize("slices", [2000, 7])
def test_pairs_are_found_by_bucket(spark, monkeypatch, slices):
    points = crowd(spark, 0.0, 0.0)
    monkeypatch.setattr(meet, "ranges_for", lambda *a: None)
    want = rows(meet.pair_observations(points, CONFIG))
    monkeypatch.setattr(crowds, "SLICES", slices)
    sizes, plain = [], crowds._dealt
    monkeypatch.setattr(crowds, "_dealt", lambda rows, bounds: sizes.append(len(bounds) + 1) or plain(rows, bounds))
    assert rows(crowds.crowded_pairs(points, [], CONFIG)) == want == rows(crowds.crowded_pairs(points, [15], CONFIG))
    monkeypatch.undo()
    monkeypatch.setattr(crowds, "LEAST_PAIRS", 0)
    monkeypatch.setattr(crowds, "CANDIDATES", 500)
    dense = spark.range(60 * 40).selectExpr("id div 40 as mmsi", "id % 40 * 300 as bucket", "10D as latitude", "20D as longitude", "id as seq")
    assert crowds.ranges_for(dense, CONFIG, None, True) == []  # one copy of each point; by pairs: 24


@pytest.mark.parametrize("place", [(0.0, 0.0, False, False), (-33.0, 151.0, False, True), (64.0, 179.99, True, False)])
def test_meetings_of_one_vessel(spark, place):
    """The same as of all meetings, and no pair of others is looked for."""
    lat, lon, exact, strict = place
    points = crowd(spark, lat, lon)
    points = points.unionByName(points.where("mmsi % 3 = 0 and bucket % 900 = 0").selectExpr("mmsi", "bucket", "latitude + 0.001 as latitude", "longitude", "seq + 100000 as seq"))
    all_ = meet.sessions_of(points, CONFIG, exact, strict, 0.5)
    for vessel in (0, 17, 39):
        want = rows(all_.where(f"{vessel} in (mmsi_a, mmsi_b)"))
        assert rows(meet.sessions_with(points, vessel, CONFIG, exact, strict, 0.5)) == want and want


def test_the_map_of_meetings_lists_no_others(spark, monkeypatch):
    from vesselwatch.plans import catalogue

    listed, plain = [], meet.sessions_of
    monkeypatch.setattr(meet, "sessions_of", lambda *a, **k: listed.append(a) or plain(*a, **k))
    assert catalogue.QUERIES["top_b_map"](spark, "/root/testdata/sf0.01").count() > 0 and len(listed) == 1  # sparse points: counted from the list
    monkeypatch.setattr(crowds, "LEAST_PAIRS", 0)
    catalogue.QUERIES["top_b_map"](spark, "/root/testdata/sf0.1").count()
    assert len(listed) == 1  # crowds: counted without it
