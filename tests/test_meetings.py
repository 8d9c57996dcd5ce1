import random
from datetime import datetime, timedelta

import pytest
from vesselwatch.config import Detection
from vesselwatch.operators import meetings as meet
from vesselwatch.operators import tracks

START = datetime(2025, 1, 1)
HALF_HOURS = Detection(meeting_sample_s=1800)


def records(spark, *rows):
    """rows: (mmsi, minutes, latitude, longitude, sog)."""
    data = [(m, START + timedelta(minutes=t), k, float(y), float(x), s, None) for k, (m, t, y, x, s) in enumerate(rows)]
    return spark.createDataFrame(data, "mmsi long, ts timestamp, seq long, latitude double, longitude double, sog double, draught double")


def no_ports(spark):
    return spark.createDataFrame([], "port_no int, port_name string, latitude double, longitude double, radius_km double")


def events(spark, rows, **options):
    t = tracks.with_track_columns(records(spark, *rows), HALF_HOURS)
    return meet.meetings(t, HALF_HOURS, no_ports(spark), **options).collect()


def pair(lon, sog=0.2, lat=0.0, a=111000111, b=222000222):
    return [r for t in range(0, 151, 30) for r in ((a, t, lat, 0.0, 0.2), (b, t, lat, lon, sog))]


def test_one_meeting(spark):
    (e,) = events(spark, pair(0.002))
    assert (e["mmsi_a"], e["mmsi_b"], e["duration_hours"], e["observations"]) == (111000111, 222000222, 2.5, 6)
    assert e["end_lon_b"] == 0.002 and e["min_distance_km"] == pytest.approx(0.2224, abs=1e-3)


@pytest.mark.parametrize("rows", [pair(0.002, sog=1.0), pair(0.006), pair(0.002)[:8]])
def test_no_meeting(spark, rows):
    assert events(spark, rows) == []


def test_nan_speed_counts_and_a_missing_catalogue_excludes_all(spark):
    assert len(events(spark, pair(0.002, sog=float("nan")))) == 1
    t = tracks.with_track_columns(records(spark, *pair(0.002)), HALF_HOURS)
    assert meet.meetings(t, HALF_HOURS, None).count() == 0


def test_high_latitude_needs_the_exact_grid(spark):
    rows = [r for t in range(0, 151, 30) for r in ((1, t, 56.0, 9.950851, 0.2), (2, t, 56.0, 9.958571, 0.2))]
    assert events(spark, rows) == []
    assert len(events(spark, rows, exact_grid=True)) == 1


@pytest.mark.parametrize("dense", [7, 1000])
def test_exact_grid_finds_all_close_pairs(spark, monkeypatch, dense):
    monkeypatch.setattr(meet, "DENSE", dense)
    rng = random.Random(2)
    rows = [(k, 0, 65 + rng.random() * 0.03, rng.random() * 0.05 - 0.02, 0.1) for k in range(150)]
    points = meet.meeting_points(tracks.with_track_columns(records(spark, *rows), HALF_HOURS), HALF_HOURS, no_ports(spark))
    got = {(r["mmsi_a"], r["mmsi_b"]) for r in meet.pair_observations(points, HALF_HOURS, exact_grid=True).collect()}
    from vesselwatch.streaming.detector import _km

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and _km(a[2], a[3], b[2], b[3]) <= 0.5}
    assert got == want and want


@pytest.mark.parametrize("base", [120.0, 179.98, -150.0])
def test_exact_grid_at_other_longitudes(spark, base):
    from vesselwatch.streaming.detector import _km

    rng = random.Random(3)
    rows = [(k, 0, 64 + rng.random() * 0.08, (base + rng.random() * 0.04 + 180) % 360 - 180, 0.1) for k in range(200)]
    points = meet.meeting_points(tracks.with_track_columns(records(spark, *rows), HALF_HOURS), HALF_HOURS, no_ports(spark))
    got = {(r["mmsi_a"], r["mmsi_b"]) for r in meet.pair_observations(points, HALF_HOURS, exact_grid=True).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and _km(a[2], a[3], b[2], b[3]) <= 0.5} and got


def _walk(observed: dict[int, set], occupied: list[int], gap: int) -> list[list[int]]:
    """Sessions of pairs by walking all occupied buckets in order: an independent statement of the rule."""
    out = []
    for pair_, seen in observed.items():
        session = []
        for b in occupied:
            if session and b - session[-1] > gap and b not in seen:
                out.append((pair_, session))
                session = []
            if b in seen:
                session.append(b)
        if session:
            out.append((pair_, session))
    return sorted((p, s[0], s[-1], len(s)) for p, s in out)


def test_sessions_equal_a_walk_over_the_buckets(spark):
    rng = random.Random(9)
    base = 1_735_689_600
    points, pairs, observed, occupied = [], [], {}, set()
    for p in range(40):
        seen = {base + 300 * rng.randrange(60) for _ in range(rng.randrange(1, 12))}
        observed[(2 * p, 2 * p + 1)] = seen
        for b in seen:
            pairs.append((2 * p, 2 * p + 1, b, 0.0, 0.0, 0.0, 0.0, 0.1))
            points.append((b,))
            occupied.add(b)
    keep = {b for b in occupied if rng.random() < 0.5 or True}
    pairs_df = spark.createDataFrame(pairs, "mmsi_a long, mmsi_b long, bucket long, latitude_a double, longitude_a double, latitude_b double, longitude_b double, km double")
    config = Detection()
    for sub in (0, 30):  # also with few occupied buckets
        chosen = {k: v for k, v in observed.items() if k[0] >= sub * 2}
        pts = spark.createDataFrame([(b,) for v in chosen.values() for b in v], "bucket long")
        got = meet.meeting_sessions(pairs_df.where(f"mmsi_a >= {sub * 2}"), pts, config).collect()
        want = _walk(chosen, sorted({b for v in chosen.values() for b in v} & keep), config.continuation_s)
        assert sorted(((r["mmsi_a"], r["mmsi_b"]), r["start_epoch"], r["end_epoch"], r["observations"]) for r in got) == want


def test_a_long_gap_ends_a_meeting_only_if_someone_is_seen_in_it(spark):
    rows = [r for r in pair(0.002) if r[1] <= 30] + [(m, t + 240, y, x, s) for m, t, y, x, s in pair(0.002)]
    assert [e["observations"] for e in events(spark, rows)] == [8]
    third = [*rows, (333000333, 120, 5.0, 5.0, 0.1), (333000333, 180, 5.0, 5.0, 0.1)]
    assert [e["observations"] for e in events(spark, third)] == [6]
    assert [e["observations"] for e in events(spark, rows, strict_gap=True)] == [6]
