import random

import numpy as np
import pytest
from vesselwatch.config import Detection
from vesselwatch.operators import crowds
from vesselwatch.operators import meetings as meet
from vesselwatch.operators import tracks
from vesselwatch.plans.daily import DailyDetection
from vesselwatch.plans.detection import run_detection

CONFIG = Detection()


def crowd(spark, lat=0.0, lon=0.0, vessels=40, seed=4):
    """Vessels in and out of a crowd of some cells, some with several points in a bucket."""
    rng = random.Random(seed)
    rows = [(m, 300 * t, lat + rng.random() * 0.012, (lon + rng.random() * 0.02 + 180) % 360 - 180) for m in range(vessels) for t in range(0, 60, 3) if rng.random() < 0.5 for _ in range(rng.choice((1, 1, 2)))]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "mmsi long, bucket long, latitude double, longitude double, seq long")


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("place", [(0.0, 0.0, False), (-33.0, 151.0, False), (64.0, 179.99, True), (89.98, 10.0, True)])
@pytest.mark.parametrize("strict", [False, True])
def test_crowds_equal_the_joins(spark, monkeypatch, place, strict):
    lat, lon, exact = place
    points = crowd(spark, lat, lon)
    monkeypatch.setattr(meet, "ranges_for", lambda *a: None)
    pairs, sessions = meet.pair_observations(points, CONFIG, exact), meet.sessions_of(points, CONFIG, exact, strict)
    want = rows(pairs), rows(sessions)
    assert len(want[0]) > 100
    monkeypatch.setattr(crowds, "CANDIDATES", 500)
    for bounds in ([], [11, 12, 30]):
        told = points.join(meet.previous_occupied(points), "bucket", "left")
        assert rows(crowds.crowded_pairs(points, bounds, CONFIG, exact)) == want[0]
        assert rows(crowds.crowded_sessions(told, bounds, CONFIG, exact, strict)) == want[1]


def test_pairs_of_a_crowd_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(crowds, "LEAST_PAIRS", 0)
    points = crowd(spark)
    for df in (meet.pair_observations(points, CONFIG), meet.sessions_of(points, CONFIG, least_h=2.0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" in plan and "hashpartitioning(mmsi_a" not in plan
    lonely = points.withColumn("latitude", points.mmsi * 0.5)
    assert crowds.ranges_for(lonely, CONFIG) is None


@pytest.mark.parametrize("least_pairs", [0, 1 << 62])
def test_long_and_open_sessions(spark, monkeypatch, least_pairs):
    points = crowd(spark)
    all_ = meet.sessions_of(points, CONFIG).collect()
    monkeypatch.setattr(crowds, "LEAST_PAIRS", least_pairs)
    got = meet.sessions_of(points, CONFIG, least_h=1.0, open_after=16000).collect()
    want = {(r["mmsi_a"], r["mmsi_b"], r["start_epoch"]) for r in all_ if r["duration_hours"] >= 1 and r["end_epoch"] <= 16000}
    assert {(r["mmsi_a"], r["mmsi_b"], r["start_epoch"]) for r in got if r["mmsi_b"] is not None} == want and want
    since, told = {}, {}
    for r in (r for r in all_ if r["end_epoch"] > 16000):
        for m in (r["mmsi_a"], r["mmsi_b"]):
            since[m] = min(since.get(m, r["start_epoch"]), r["start_epoch"])
    for r in (r for r in got if r["mmsi_b"] is None):
        told[r["mmsi_a"]] = min(told.get(r["mmsi_a"], r["start_epoch"]), r["start_epoch"])
    assert told == since and since


def test_days_keep_no_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(crowds, "LEAST_PAIRS", 0)
    rows = [(210000000 + v, t, v * 1000 + t, 10.0, 20.0, 0.1, None) for v in range(30) for t in range(0, 9600, 1200)]
    records = spark.createDataFrame(rows, "mmsi long, t long, seq long, latitude double, longitude double, sog double, draught double").selectExpr("mmsi", "timestamp_seconds(t) as ts", "seq", "latitude", "longitude", "sog", "draught")
    ports = spark.createDataFrame([], "port_no int, port_name string, latitude double, longitude double, radius_km double")
    runs = DailyDetection(spark, f"file://{tmp_path}", CONFIG, ports)
    for k in range(2):
        runs.add(records.where(f"unix_seconds(ts) div 4800 = {k}"), k)
        kept = [spark.read.parquet(str(p)).count() for p in tmp_path.glob("*/run=*") if p.parent.name not in ("done", "vessels")]
        assert max(kept) <= len(rows)  # 435 pairs, 240 points
    runs.close()
    assert runs.events("meetings").count() == 435


@pytest.mark.parametrize("place", [(0.0, 0.0, False, False), (-33.0, 151.0, False, True), (64.0, 179.99, True, True), (89.98, 10.0, True, False)])
def test_sessions_are_counted_where_they_are_found(spark, monkeypatch, place):
    lat, lon, exact, strict = place
    points = crowd(spark, lat, lon)
    monkeypatch.setattr(meet, "ranges_for", lambda *a: None)
    want = rows(meet.session_counts(points, CONFIG, exact, strict, 0.5))
    assert want == rows(meet.counted(meet.sessions_of(points, CONFIG, exact, strict, 0.5))) and len(want) > 5
    monkeypatch.setattr(crowds, "COUNTED_AT_A_TIME", 500)
    for bounds in ([], [11, 12, 30]):
        monkeypatch.setattr(meet, "ranges_for", lambda *a, b=bounds: b)
        assert rows(meet.session_counts(points, CONFIG, exact, strict, 0.5)) == want


def test_counts_at_the_very_distance(spark, monkeypatch):
    """Pairs whose distance is the limit or next to it: the chord can't tell these."""
    far = float(crowds.haversine_km_of(*(np.array([v]) for v in (10.0, 20.0, 10.003, 20.002)))[0])
    points = spark.createDataFrame([(m, 300 * t, 10.0 + 0.003 * m, 20.0 + 0.002 * m, 2 * t + m) for t in range(30) for m in (0, 1)], "mmsi long, bucket long, latitude double, longitude double, seq long")
    monkeypatch.setattr(meet, "ranges_for", lambda *a: [])
    for km, met in ((far, 2), (float(np.nextafter(far, 0)), 0), (float(np.nextafter(far, 1)), 2)):
        assert meet.session_counts(points, Detection(meeting_km=km), least_h=2.0).count() == met


def test_vessels_need_no_list_of_meetings(spark, monkeypatch):
    """A vessel's number of meetings comes from groups of crowds as one row a vessel, not as one for each meeting."""
    monkeypatch.setattr(crowds, "LEAST_PAIRS", 0)
    listed = []
    monkeypatch.setattr(meet, "sessions_of", lambda *a, **k: listed.append(a))
    records = spark.range(30 * 8).selectExpr("210000000 + id div 8 as mmsi", "timestamp_seconds(id % 8 * 1200) as ts", "id as seq", "10D as latitude", "20D as longitude", "0.1D as sog", "cast(null as double) as draught")
    ports = spark.createDataFrame([], "port_no int, port_name string, latitude double, longitude double, radius_km double")
    found = run_detection(records, ports, config=CONFIG)
    assert {r["meeting_events"] for r in found.vessels.collect()} == {29} and found.meeting_counts.count() == 30 and not listed


@pytest.mark.parametrize("gap_s", [600, 9000])
def test_counts_over_many_buckets(spark, monkeypatch, gap_s):
    """More buckets than a number has bits: windows, or single observations if a gap may be too long for these."""
    rng = random.Random(8)
    rows_ = [(m, 300 * t, rng.random() * 0.012, rng.random() * 0.02, m * 1000 + t) for m in range(24) for t in range(0, 230) if t % 50 < 44 and rng.random() < 0.4]
    points = spark.createDataFrame(rows_, "mmsi long, bucket long, latitude double, longitude double, seq long")
    config = Detection(meeting_gap_s=gap_s)
    monkeypatch.setattr(meet, "ranges_for", lambda *a: None)
    want = rows(meet.session_counts(points, config, least_h=1.0))
    assert len(want) > 5
    monkeypatch.setattr(meet, "ranges_for", lambda *a: [11])
    assert rows(meet.session_counts(points, config, least_h=1.0)) == want


def test_a_crowd_is_compared_by_places(monkeypatch):
    """Where all points of two places are close their vessels are compared, not their points."""
    vessels, buckets = 300, 40
    mmsi, bucket = np.repeat(np.arange(vessels), buckets), np.tile(np.arange(buckets) * 300, vessels)
    side = {"mmsi": mmsi, "bucket": bucket, "latitude": 10 + mmsi % 7 * 2e-4, "longitude": 20 + bucket // 300 % 5 * 2e-4, "no": mmsi, "vessels": np.arange(vessels)}
    compared, plain = [], crowds._candidates

    def seen(*given):
        for found in plain(*given):
            compared.append(len(found[0]))
            yield found

    monkeypatch.setattr(crowds, "_candidates", seen)
    occupied = np.arange(buckets) * 300
    told, n = crowds._counts(side, side, occupied, np.r_[crowds.NEVER, occupied[:-1]], CONFIG, crowds.grid_degrees(CONFIG.meeting_km), False, False, 2.0)
    assert np.bincount(told, n).tolist() == [vessels - 1] * vessels
    assert sum(compared) < vessels  # by points: 1,794,000


def test_vessels_take_one_pass_over_the_tracks(spark, monkeypatch):
    """Sums and meeting points come from the same windows; slices of hot tracks give the same."""
    rows_ = [(210000000 + v, t * 600, v * 1000 + t, 10.0 + (3.0 if t % 40 == 39 else 0.0), 20.0, 0.1, 5.0 + t % 3) for v in range(6) for t in range(60) if v == 0 or t % 7]
    records = spark.createDataFrame(rows_, "mmsi long, t long, seq long, latitude double, longitude double, sog double, draught double").selectExpr("mmsi", "timestamp_seconds(t) as ts", "seq", "latitude", "longitude", "sog", "draught")
    ports = spark.createDataFrame([(1, "a", 13.0, 20.0, 3.0)], "port_no int, port_name string, latitude double, longitude double, radius_km double")
    passes, plain = [], tracks.with_track_columns
    monkeypatch.setattr(tracks, "with_track_columns", lambda *a, **k: passes.append(a) or plain(*a, **k))
    got = []
    for options in ({"share": None}, {"share": 0.15, "least": 10}):
        passes.clear()
        found = run_detection(records, ports, config=CONFIG, **options)
        got.append(rows(found.vessels))
        assert len(passes) == 1
        listed = run_detection(records, ports, config=CONFIG, **options)
        assert listed.meetings.count() > 0 and rows(listed.vessels) == got[-1]  # with meetings listed
    assert got[0] == got[1] and max(r["meeting_events"] for r in found.vessels.collect()) > 0
