"""Runs day by day against one run over all; hot vessels against whole tracks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from vesselwatch.config import Detection
from vesselwatch.operators import score, tracks
from vesselwatch.plans.daily import DailyDetection
from vesselwatch.plans.detection import run_detection

START = datetime(2025, 1, 1)
SCHEMA = "mmsi long, ts timestamp, seq long, latitude double, longitude double, sog double, draught double"
CONFIG = Detection(meeting_h=1.0)


def made(spark, vessels=6, n=120, seed=3):
    """Vessels that wander, fall silent, jump, change draught, and lie beside each other in pairs."""
    rng, rows = random.Random(seed), []
    for pair in range((vessels + 1) // 2):
        t, lat = rng.randrange(600), 10 + pair * 0.5
        for _ in range(n):
            t += rng.choice([20, 60, 200, 300, 600, 600, 600, 1200, 1200, 1200, 1200, 20_000])
            for v in range(2 * pair, min(2 * pair + 2, vessels)):
                far = rng.random() < 0.07
                rows.append((210000000 + v, START + timedelta(seconds=t), len(rows), lat + rng.random() * 0.002 + (rng.choice([1.0, 3.0]) if far else 0), 20.0, rng.choice([0.1, 0.2, 0.5, 0.5, 5.0]), rng.choice([5.0, 6.0, None])))
    return spark.createDataFrame(rows, SCHEMA)


def ports(spark):
    return spark.createDataFrame([(0, "p", 12.0, 20.0, 5.0)], "port_no int, port_name string, latitude double, longitude double, radius_km double")


def lines(df):
    kinds = [F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in sorted(df.dtypes)]
    return sorted(str(r) for r in df.select(*kinds).collect())


@pytest.mark.parametrize(("options", "shares"), [({}, (0.2, 0.5)), ({"share": 0.1, "least": 10}, (0.4,))])
def test_days_equal_one_run(spark, tmp_path, options, shares):
    records = made(spark)
    whole = run_detection(records, ports(spark), None, CONFIG, share=None)
    runs = DailyDetection(spark, f"file://{tmp_path}", CONFIG, ports(spark), None, **options)
    low, high = records.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    cuts = [low, *(low + int((high - low) * s) + 7 for s in shares), high + 1]  # wherever in a bucket or meeting
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        assert runs.add(records.where(F.unix_seconds("ts").between(a, b - 1)), k)
    assert not runs.add(records, k)  # merged already
    assert not runs.add(records, 0)
    runs.close()
    for name in DailyDetection.EVENTS:
        want = lines(getattr(whole, name))
        assert want and lines(runs.events(name)) == want, name
    assert lines(runs.vessels()) == lines(whole.vessels)


def test_a_run_that_failed_is_repeated(spark, tmp_path):
    records = made(spark, 2, 40)
    runs = DailyDetection(spark, f"file://{tmp_path}", CONFIG, ports(spark), None)
    runs._write(records.limit(3), "silences", 0)  # left by a run without its last step
    assert runs.events("silences") is None and runs.vessels() is None
    assert runs.add(records, 0)
    assert lines(runs.events("silences")) == lines(run_detection(records, ports(spark), None, CONFIG).silences)


def test_runs_without_records(spark, tmp_path):
    records = made(spark, 2, 40)
    runs = DailyDetection(spark, f"file://{tmp_path}", CONFIG, ports(spark), None)
    for k, part in enumerate((records.limit(0), records, records.limit(0))):
        assert runs.add(part, k)
    runs.close()
    whole = run_detection(records, ports(spark), None, CONFIG)
    assert lines(runs.vessels()) == lines(whole.vessels)
    assert lines(runs.events("meetings")) == lines(whole.meetings)


def test_hot_vessels_are_found_and_sliced(spark):
    hot = made(spark, 1, 600, 5)
    others = made(spark, 30, 12, 6).withColumn("mmsi", F.col("mmsi") + 1000)
    records = hot.unionByName(others)
    assert tracks.hot_vessels(records, 0.2, 100) == [210000000]
    assert tracks.hot_vessels(records, 0.2, 10_000) == []
    plain, sliced = (run_detection(records, ports(spark), None, CONFIG, share=s, least=100) for s in (None, 0.2))
    assert sliced.tracks == {"hot": [210000000]}
    for name in ("detected", "vessels", "silences", "jumps", "meetings"):
        assert lines(getattr(plain, name)) == lines(getattr(sliced, name)), name
    parts = sliced._parts.groupBy("mmsi", "part").count()
    assert parts.where("part is not null").agg(F.max("count")).first()[0] < 40  # no group holds the track
    assert parts.where("mmsi <> 210000000 and part is not null").isEmpty()


def test_episodes_over_slices_need_no_window_over_the_vessel(spark):
    """An identity that changes places every minute: each record is a jump."""
    rows = [(210000000, START + timedelta(seconds=60 * k + (9000 if k > 200 else 0)), k, 10.0 + 2 * (k % 2), 20.0, 5.0, None) for k in range(400)]
    records = spark.createDataFrame(rows, SCHEMA)
    plain = score.vessel_summary(tracks.detect(records, CONFIG), None, CONFIG).first()
    sliced = score.vessel_summary(tracks.detect(records, CONFIG, hot=[210000000]), None, CONFIG)
    assert plain["d1_episodes"] == 2 and plain["d1_events"] == 398
    assert sliced.first().asDict() == plain.asDict()
    # windows by vessel alone see a row for each slice
    summaries = score.track_summaries(tracks.detect(records, CONFIG, hot=[210000000]), CONFIG)
    assert summaries.count() < 30 and summaries.agg(F.max(F.size("d1_starts"))).first()[0] == 1


def test_counts_are_observed_while_results_are_written(spark):
    records = made(spark, 4, 80)
    kept = run_detection(records, ports(spark), None, CONFIG).kept()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("metrics", "metrics")
    found = kept.metrics()
    assert not tracker.getJobIdsForGroup("metrics")
    spark.sparkContext.setJobGroup("others", "others")
    assert found == {"records": records.count(), "vessels": 4} | {n: getattr(kept, n).count() for n in ("silences", "draught_changes", "jumps", "meetings")}
