"""Numbers of meetings from day to day, without a list of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_daily import CONFIG, lines, made, ports
from vesselwatch.config import Detection
from vesselwatch.operators import crowds
from vesselwatch.operators import meetings as meet
from vesselwatch.plans.daily import DailyDetection
from vesselwatch.plans.detection import run_detection


def crowded(spark):
    """Twelve vessels in a crowd with pauses, over more buckets than a number has bits."""
    rng = random.Random(7)
    rows = [(210000000 + v, 1_700_000_000 + 1200 * t, v * 1000 + t, 10.0 + rng.random() * 0.004, 20.0, 0.1, 5.0) for v in range(12) for t in range(150) if t % 40 < 35 and rng.random() < 0.75]
    return spark.createDataFrame(rows, "mmsi long, t long, seq long, latitude double, longitude double, sog double, draught double").selectExpr("mmsi", "timestamp_seconds(t) as ts", "seq", "latitude", "longitude", "sog", "draught")


@pytest.mark.parametrize(("crowd", "shares"), [(False, (0.2, 0.5)), (True, (0.3, 0.34, 0.36, 0.8))])
def test_counted_days_equal_one_run(spark, tmp_path, monkeypatch, crowd, shares):
    records = crowded(spark) if crowd else made(spark)
    whole = run_detection(records, ports(spark), None, CONFIG, share=None)
    if crowd:
        monkeypatch.setattr(crowds, "LEAST_PAIRS", 0)
        monkeypatch.setattr(meet, "ranges_for", lambda *a: [210000005])
        monkeypatch.setattr(meet, "sessions_of", None)  # nothing is listed
    runs = DailyDetection(spark, f"file://{tmp_path}", CONFIG, ports(spark), None, list_meetings=False)
    low, high = records.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    cuts = [low, *(low + int((high - low) * s) + 7 for s in shares), high + 1]
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        assert runs.add(records.where(F.unix_seconds("ts").between(a, b - 1)), k)
    runs.close()
    monkeypatch.undo()
    want = lines(whole.vessels)
    assert lines(runs.vessels()) == want and whole.vessels.agg(F.sum("meeting_events")).first()[0] > 5
    assert runs.events("meetings") is None


@pytest.mark.parametrize("gap_s", [600, 9000, 40000])
@pytest.mark.parametrize("buckets", [40, 200])
def test_sessions_are_counted_by_their_ends(gap_s, buckets):
    """By bits, by windows of them and by numbers, against sessions put together one by one."""
    rng, config = random.Random(gap_s + buckets), Detection(meeting_gap_s=gap_s)
    seen = {(v, t) for v in range(7) for t in range(buckets) if t % 31 < 25 and rng.random() < 0.6}
    occupied = np.array(sorted({t for _, t in seen})) * 1200
    before = dict(zip(occupied.tolist(), [crowds.NEVER, *occupied.tolist()], strict=False))
    rows = np.array(sorted(seen))
    side = {"mmsi": rows[:, 0], "bucket": rows[:, 1] * 1200, "latitude": np.full(len(rows), 10.0), "longitude": np.full(len(rows), 20.0), "no": rows[:, 0], "vessels": np.arange(7)}
    sessions = []
    for a in range(7):
        for b in range(a + 1, 7):
            last = None
            for t in (1200 * t for t in range(buckets) if (a, t) in seen and (b, t) in seen):
                if last is None or before[t] - last[1] > config.continuation_s:
                    last = [t, t, a, b]
                    sessions.append(last)
                last[1] = t
    for ends in ((None, None), (None, 36000), (12000, 48000), (24000, None)):
        want = np.zeros(7, int)
        for s, e, a, b in sessions:
            if e - s >= 7200 and (ends[0] is None or e >= ends[0]) and (ends[1] is None or e < ends[1]):
                want[[a, b]] += 1
        told, n = crowds._counts(side, side, occupied, np.array([before[t] for t in occupied.tolist()]), config, crowds.grid_degrees(config.meeting_km), False, False, 2.0, ends)
        assert np.bincount(told, n, 7).astype(int).tolist() == want.tolist()
