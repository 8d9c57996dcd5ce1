import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from vesselwatch.config import Detection
from vesselwatch.functions.geo import land_by_cell, nearest_port, ports_by_cell, with_near_port, with_on_land
from vesselwatch.operators import score, tracks
from vesselwatch.plans.detection import run_detection
from vesselwatch.sources.tables import land_from_rings

START = datetime(2025, 1, 1)
SCHEMA = "mmsi long, ts timestamp, seq long, latitude double, longitude double, sog double, draught double"


def records(spark, *points):
    """points: (minutes, latitude, longitude, draught[, mmsi])."""
    rows = [(p[4] if len(p) > 4 else 200000001, START + timedelta(minutes=p[0]), k, float(p[1]), float(p[2]), 5.0, p[3]) for k, p in enumerate(points)]
    return spark.createDataFrame(rows, SCHEMA)


def ports(spark, *rows):
    return spark.createDataFrame([(k, f"p{k}", *map(float, r)) for k, r in enumerate(rows)], "port_no int, port_name string, latitude double, longitude double, radius_km double")


def found(spark, points, config=None, port_rows=None, land=None):
    d = tracks.detect(records(spark, *points), config, ports(spark, *port_rows) if port_rows is not None else None, land)
    return {"A": tracks.silences(d).count(), "C": tracks.draught_changes(d).count(), "D": [r["subtype"] for r in tracks.jumps(d).collect()]}


@pytest.mark.parametrize(
    ("points", "expected"),
    [
        ([(0, 10, 20, 8.0), (300, 10.02, 20, 8.0)], {"A": 1, "C": 0, "D": []}),
        ([(0, 10, 20, 8.0), (240, 10.02, 20, 8.0)], {"A": 0, "C": 0, "D": []}),  # exactly four hours
        ([(0, 10, 20, 10.0), (180, 10, 20, 11.0)], {"A": 0, "C": 1, "D": []}),
        ([(0, 10, 20, 10.0), (180, 10, 20, 10.5)], {"A": 0, "C": 0, "D": []}),  # exactly the ratio
        ([(0, 10, 20, 10.0), (180, 10, 20, None)], {"A": 0, "C": 0, "D": []}),
        ([(0, 10, 20, 0.0), (180, 10, 20, 9.0)], {"A": 0, "C": 0, "D": []}),
        ([(0, 10, 20, 9.0), (180, 10, 20, 0.0)], {"A": 0, "C": 1, "D": []}),
        ([(0, 10, 20, 9.0), (180, 10, 20, float("nan"))], {"A": 0, "C": 1, "D": []}),
        ([(0, 10, 20, 8.0), (20, 12, 20, 8.0)], {"A": 0, "C": 0, "D": ["D1"]}),
        ([(0, 10, 20, 8.0), (120, 12, 20, 8.0)], {"A": 0, "C": 0, "D": ["D2"]}),
        ([(0, 10, 20, 8.0), (1 / 3, 11, 20, 8.0)], {"A": 0, "C": 0, "D": []}),  # 20 seconds
        ([(0, 0, 0, 8.0), (20, 12, 20, 8.0)], {"A": 0, "C": 0, "D": []}),
        ([(0, 10, 20, 8.0), (1500, 20, 20, 8.0)], {"A": 1, "C": 0, "D": []}),  # beyond a day
        ([(0, 10, 20, 10.0), (300, 10.02, 20, 11.0)], {"A": 1, "C": 1, "D": []}),
    ],
)
def test_detectors(spark, points, expected):
    assert found(spark, points) == expected


def test_thresholds_and_ports(spark):
    far = Detection(silence_km=5.0, jump_km=500.0)
    assert found(spark, [(0, 10, 20, 8.0), (360, 10.01, 20, 8.0)], far)["A"] == 0
    change = [(0, 10, 20, 10.0), (180, 10.2, 20, 11.0)]
    assert found(spark, change, port_rows=[(10, 20, 5)])["C"] == 0
    assert found(spark, change, port_rows=[(0, 0, 5)])["C"] == 1
    assert found(spark, change, port_rows=[])["C"] == 1
    wide = Detection(draught_port_km=30.0)
    assert found(spark, change, wide, port_rows=[(10.4, 20, 1)])["C"] == 0


def test_samples_are_the_first_of_buckets(spark):
    points = [(0, 1, 1, None), (1, 1, 1, None), (5, 1, 1, None), (9, 1, 1, None)]
    t = tracks.with_track_columns(records(spark, *points), Detection()).orderBy("ts")
    assert [r["is_sample"] for r in t.collect()] == [True, False, True, False]
    every = Detection(track_sample_s=0)
    assert tracks.with_track_columns(records(spark, *points), every).where("is_sample").count() == 4


def test_an_event_over_a_straddled_bucket_counts_once(spark):
    assert found(spark, [(0, 10, 20, 8.0), (1, 10, 20, 8.0), (300, 10.5, 20, 8.0)])["A"] == 1


def test_order_and_partitioning_do_not_matter(spark):
    points = [(k * 37 % 3000, 10 + (k % 7) * 0.5, 20, 8.0 + k % 3, 200000001 + k % 4) for k in range(200)]
    df = records(spark, *points)
    get = lambda d: sorted(map(tuple, tracks.jumps(tracks.detect(d)).select("mmsi", "subtype", "start_ts", "end_ts").collect()))
    assert get(df) == get(df.repartition(7).orderBy(F.rand(1))) and get(df)


def test_land_quality(spark):
    land = land_from_rings(spark, [[[(0, 11), (30, 11), (30, 15), (0, 15)], [(19, 13), (21, 13), (21, 14), (19, 14)]]])
    jump = [(0, 10, 20, 8.0), (120, 12, 20, 8.0)]
    quality = lambda points, ports_, mask: tracks.jumps(tracks.detect(records(spark, *points), None, ports_, mask)).first()
    assert quality(jump, None, land)["quality_flag"] == "suspect_land_point"
    assert quality(jump, ports(spark, (12, 20.1, 1)), land)["quality_flag"] == "suspect_land_point_near_port"
    hole = quality([(0, 10, 20, 8.0), (180, 13.5, 20, 8.0)], None, land)
    assert hole["quality_flag"] == "ok" and hole["counts"] and hole["end_on_land"] is False
    none = quality(jump, None, None)
    assert none["quality_flag"] == "suspect_land_point" and none["end_on_land"] is None and not none["counts"]
    on_edge = with_on_land(records(spark, (0, 11, 20, None), (0, 11.5, 20, None)), land_by_cell(land), "latitude", "longitude", "l", F.lit(True))
    assert sorted(r["l"] for r in on_edge.collect()) == [False, True]


def test_ports(spark):
    points = records(spark, (0, 10.02, 20, None), (1, 11, 20, None), (2, 10.03, 20, None), (3, 0, -179.99, None))
    near = lambda rows, floor=0.0: [r["n"] for r in with_near_port(points, ports_by_cell(ports(spark, *rows), floor), "latitude", "longitude", "n").orderBy("seq").collect()]
    assert near([(10, 20, 5)]) == [True, False, True, False]
    assert near([(10, 20, 1)]) == [False, False, False, False]
    assert near([(10, 20, 1)], 5.0) == [True, False, True, False]
    assert near([(0, 179.99, 5)]) == [False, False, False, True]  # across the date line
    assert near([]) == [False] * 4
    best = nearest_port(points, ports(spark, (10, 20, 5), (50, 60, 5)), ["seq"]).orderBy("seq").collect()
    assert [r["port_name"] for r in best] == ["p0", "p0", "p0", "p1"]
    assert nearest_port(points, ports(spark), ["seq"]).count() == 0


@pytest.mark.parametrize(("second", "episodes"), [(60, 1), (180, 2), (130, 1)])
def test_episodes(spark, second, episodes):
    lat = [10, 12, 12, 10] if second else []
    points = [(0, lat[0], 20, 8.0), (10, lat[1], 20, 8.0), (second, lat[2], 20, 8.0), (second + 10, lat[3], 20, 8.0)]
    summary = score.vessel_summary(tracks.detect(records(spark, *points))).first()
    assert (summary["d1_events"], summary["d1_episodes"]) == (2, episodes)


def test_score_and_rank(spark):
    columns = "mmsi long, max_gap_hours double, impossible_jump_km double, draught_events long, d1_episodes long"
    df = spark.createDataFrame([(1, 10.0, 185.2, 1, 1), (2, 0.0, 0.0, 0, 0), (3, 10.0, 185.2, 1, 1), (4, 10.0, 0.0, 2, 0)], columns)
    got = score.ranked(score.with_score(df)).orderBy("rank").collect()
    assert [(r["mmsi"], r["score"], r["rank"]) for r in got] == [(1, 50.0, 1), (3, 50.0, 2), (4, 35.0, 3), (2, 0.0, 4)]
    assert [r["mmsi"] for r in score.top_vessels(score.with_score(df), 2).orderBy("rank").collect()] == [1, 3]


def test_slices_change_nothing(spark):
    rng = random.Random(7)
    rows = []
    for v in range(3):
        t = 0
        for _ in range(150):
            t += rng.choice([0, 20, 60, 200, 1200, 20_000, 90_000])
            rows.append((210000000 + v, START + timedelta(seconds=t), len(rows), 10 + rng.random() * rng.choice([0.001, 5]), 20.0, rng.choice([0.5, None]), rng.choice([5.0, 6.0, None])))
    df = spark.createDataFrame(rows, "mmsi long, ts timestamp, seq long, latitude double, longitude double, sog double, draught double")
    plain, sliced = (run_detection(df, ports(spark), None, Detection(), slice_s=s) for s in (None, 3600))
    for a, b in ((plain.detected, sliced.detected), (plain.vessels, sliced.vessels), (plain.jumps, sliced.jumps)):
        columns = sorted(a.columns)
        rows_of = lambda x: sorted((str(r) for r in x.select(*columns).collect()))  # noqa: B023, E731
        assert sorted(b.columns) == columns and rows_of(a) == rows_of(b)
    assert plain.vessels.agg(F.sum("d1_episodes")).first()[0] > 0
    with pytest.raises(ValueError, match="whole sampling buckets"):
        tracks.with_track_columns(df, Detection(), 1000)


def test_another_rule_for_quality(spark):
    points = [(0, 10, 20, 8.0), (120, 12, 20, 8.0), (240, 14, 20, 8.0)]
    land = land_from_rings(spark, [[[(19.0, 9.0), (21.0, 9.0), (21.0, 11.0), (19.0, 11.0)]]])
    rule = lambda start, end, near: F.when(start, "from_land").otherwise("ok")
    usual, other = (run_detection(records(spark, *points), ports(spark), land, quality=q) for q in (None, rule))
    flags = lambda found: [r["quality_flag"] for r in found.jumps.orderBy("end_ts").collect()]
    assert flags(usual) == ["suspect_land_point", "ok"] and flags(other) == ["from_land", "ok"]
    everything = run_detection(records(spark, *points), ports(spark), None, quality=lambda start, end, near: F.lit("ok"))
    assert everything.vessels.first()["d2_valid_events"] == 2 and run_detection(records(spark, *points), ports(spark), None).vessels.first()["d2_valid_events"] == 0
