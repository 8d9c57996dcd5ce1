from vesselwatch.config import Detection
from vesselwatch.operators import crowds
from vesselwatch.operators import meetings as meet
from vesselwatch.streaming.meetings import close_meetings, rolling_meetings


def test_meetings_of_a_crowd_are_written_once(spark, tmp_path, monkeypatch):
    """No table of sessions beside the events."""
    config = Detection(meeting_h=1.0)
    rows = [(v, 300 * t, 10.0, 20.0, 100 * t + v) for t in range(48) for v in range(20) if v < 10 or (t + 7 * v) % 12 < 5]
    points = spark.createDataFrame(rows, "mmsi long, bucket long, latitude double, longitude double, seq long")
    want = meet.sessions_of(points, config, least_h=1.0)
    monkeypatch.setattr(crowds, "LEAST_PAIRS", 0)
    monkeypatch.setattr("vesselwatch.streaming.meetings.stored", None, raising=False)
    for k, (low, high) in enumerate(((0, 15), (15, 30), (30, 48))):
        (tmp_path / "in").mkdir(exist_ok=True)
        points.where(f"bucket >= {300 * low} and bucket < {300 * high}").toPandas().to_parquet(tmp_path / "in" / f"{k}.parquet")
        rolling_meetings(spark.readStream.schema(points.schema).parquet(str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "state"), config)
    close_meetings(spark, str(tmp_path / "table"), config)
    got = spark.read.parquet(str(tmp_path / "table/events")).drop("batch")
    told = lambda df: sorted((r["mmsi_a"], r["mmsi_b"], r["start_epoch"], r["end_epoch"], r["observations"]) for r in df.collect())
    assert told(got) == told(want) and len(told(got)) >= 45
