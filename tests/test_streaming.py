import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from vesselwatch.config import Detection
from vesselwatch.operators import meetings, tracks
from vesselwatch.sources import sinks
from vesselwatch.sources.tables import land_from_rings
from vesselwatch.streaming.detector import judged, run_available, stream_events
from vesselwatch.streaming.meetings import close_meetings, rolling_meetings

START = datetime(2025, 1, 1)


def _records(spark):
    rows = [(200000001 + k % 3, START + timedelta(minutes=17 * k + (k % 5) * 90), k, 10 + (k * 7 % 11) * 0.4, 20.0, 5.0, 8.0) for k in range(240)]
    return spark.createDataFrame(rows, "mmsi long, ts timestamp, seq long, latitude double, longitude double, sog double, draught double")


def _keys(df, kind):
    return sorted((r["mmsi"], r[kind], r["start_epoch"], r["end_epoch"]) for r in df.collect())


def test_stream_equals_batch_however_it_is_cut(spark, tmp_path):
    records = _records(spark)
    flat = records.select("mmsi", F.unix_seconds("ts").alias("epoch"), "seq", "latitude", "longitude").toPandas().sort_values(["epoch", "seq"])
    (tmp_path / "in").mkdir()
    for k in range(4):
        part = flat.iloc[k * 60 : (k + 1) * 60]
        part.to_parquet(tmp_path / "in" / f"{k}.parquet")
        # one file at a time, in order, over the same checkpoint: a restart between any two
        source = spark.readStream.schema("mmsi long, epoch long, seq long, latitude double, longitude double").parquet(str(tmp_path / "in"))
        run_available(stream_events(source), str(tmp_path / "out"), str(tmp_path / "state"))
    d = tracks.detect(records)
    epochs = [F.unix_seconds("start_ts").alias("start_epoch"), F.unix_seconds("end_ts").alias("end_epoch")]
    batch = tracks.jumps(d).select("mmsi", F.col("subtype").alias("kind"), *epochs).union(tracks.silences(d).select("mmsi", F.lit("A"), *epochs))
    got = _keys(spark.read.parquet(str(tmp_path / "out")), "kind")
    assert got == _keys(batch, "kind") and got


def test_late_records_are_dropped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "mmsi long, epoch long, seq long, latitude double, longitude double"
    for k, rows in enumerate([[(1, 10_000, 1, 10.0, 20.0)], [(1, 9_000, 2, 50.0, 20.0), (1, 11_000, 3, 12.0, 20.0)]]):
        spark.createDataFrame(rows, schema).toPandas().to_parquet(tmp_path / "in" / f"{k}.parquet")
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        run_available(stream_events(source), str(tmp_path / "out"), str(tmp_path / "state"))
    (event,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert (event["kind"], event["start_epoch"], event["end_epoch"]) == ("D1", 10_000, 11_000)


def test_late_records_are_returned_and_states_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "mmsi long, epoch long, seq long, latitude double, longitude double, draught double"
    parts = [[(1, 10_000, 1, 10.0, 20.0, 5.0), (2, 10_000, 1, 0.5, 0.5, 5.0)], [(1, 9_000, 2, 50.0, 20.0, 5.0), (1, 40_000, 3, 10.0, 20.0, 8.0)], [(2, 900_000, 3, 0.5, 0.5, 5.0)], [(2, 900_100, 4, 0.5, 0.5, 5.0)], [(1, 900_200, 5, 12.0, 20.0, 8.0)]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).toPandas().to_parquet(tmp_path / "in" / f"{k}.parquet")
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        run_available(stream_events(source, forget_hours=24, with_late=True), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r["kind"], r["mmsi"], r["start_epoch"], r["end_epoch"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # vessel 1 was forgotten in the meantime: its return is no silence, nor is that of vessel 2, which stayed where it was
    assert got == [("C", 1, 10_000, 40_000), ("late", 1, 9_000, 10_000)]


def test_stream_finds_draught_changes_and_judges_jumps(spark, tmp_path):
    rng = random.Random(4)
    rows = [(200000001 + k % 4, START + timedelta(minutes=13 * k + (k % 50 == 0) * 600), k, 10 + rng.random() * (k % 9 == 0) * 8, 20.0, 5.0, None if k % 11 == 0 else 5.0 + (k % 3)) for k in range(400)]
    records = spark.createDataFrame(rows, "mmsi long, ts timestamp, seq long, latitude double, longitude double, sog double, draught double")
    ports = spark.createDataFrame([(0, "p", 15.0, 20.0, 150.0)], "port_no int, port_name string, latitude double, longitude double, radius_km double")
    land = land_from_rings(spark, [[[(15.0, 12.0), (25.0, 12.0), (25.0, 14.0), (15.0, 14.0)]]])
    config = Detection(track_sample_s=60, draught_h=0.1)
    flat = records.select("mmsi", F.unix_seconds("ts").alias("epoch"), "seq", "latitude", "longitude", "draught").toPandas().sort_values(["epoch", "seq"])
    (tmp_path / "in").mkdir()
    for k in range(4):
        flat.iloc[k * 100 : (k + 1) * 100].to_parquet(tmp_path / "in" / f"{k}.parquet")
        source = spark.readStream.schema("mmsi long, epoch long, seq long, latitude double, longitude double, draught double").parquet(str(tmp_path / "in"))
        run_available(stream_events(source, config), str(tmp_path / "out"), str(tmp_path / "state"))
    got = judged(spark.read.parquet(str(tmp_path / "out")), config, ports, land)
    d = tracks.detect(records, config, ports, land)
    epochs = [F.unix_seconds("start_ts").alias("start_epoch"), F.unix_seconds("end_ts").alias("end_epoch")]
    want = tracks.jumps(d).select("mmsi", F.col("subtype").alias("kind"), *epochs, "quality_flag", "counts").union(tracks.draught_changes(d).select("mmsi", F.lit("C"), *epochs, F.lit(None), F.lit(None)))
    keys = lambda df: sorted((tuple(r) for r in df.where("kind <> 'A'").select("mmsi", "kind", "start_epoch", "end_epoch", "quality_flag", "counts").collect()), key=str)
    assert keys(got) == keys(want) and {k[1] for k in keys(want)} == {"C", "D1", "D2"}


@pytest.mark.parametrize("cuts", [1, 5])
def test_rolling_meetings_equal_the_batch(spark, tmp_path, cuts):
    rng = random.Random(3)
    rows = []
    for step in range(160):  # six vessels, which meet and part
        for v in range(6):
            if rng.random() < 0.8:
                away = 0.0 if (step // 25 + v // 2) % 3 or v % 2 == 0 else 0.1
                rows.append((v, 600 * step, 0.001 * v, 10.0 + away, 100 * step + v))
    config = Detection(meeting_h=0.5)
    points = spark.createDataFrame(rows, "mmsi long, bucket long, latitude double, longitude double, seq long")
    want = meetings.meeting_sessions(meetings.pair_observations(points, config), points, config).where("duration_hours >= 0.5").drop("session")
    order = sorted(rows, key=lambda r: r[1])
    (tmp_path / "in").mkdir()
    sizes = sorted(rng.sample(range(1, len(rows)), cuts - 1)) + [len(rows)]
    # cut between buckets only: a bucket before the newest one is complete
    sizes = sorted({next((k for k in range(s, len(order)) if order[k][1] != order[k - 1][1]), len(order)) for s in sizes})
    at = 0
    for k, end in enumerate(sizes):
        spark.createDataFrame(order[at:end], points.schema).toPandas().to_parquet(tmp_path / "in" / f"{k}.parquet")
        at = end
        source = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
        rolling_meetings(source, str(tmp_path / "table"), str(tmp_path / "state"), config)
    early = spark.read.parquet(str(tmp_path / "table/events")).count()
    close_meetings(spark, str(tmp_path / "table"), config)
    got = spark.read.parquet(str(tmp_path / "table/events")).drop("batch")
    rows_of = lambda df: sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)
    assert rows_of(got) == rows_of(want) and 0 < early < want.count()
    # a point of a bucket that was processed is kept apart
    spark.createDataFrame([(9, 600, 0.0, 0.0, 1)], points.schema).toPandas().to_parquet(tmp_path / "in" / "late.parquet")
    rolling_meetings(spark.readStream.schema(points.schema).parquet(str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "state"), config)
    assert spark.read.parquet(str(tmp_path / "table/late")).count() == 1


def test_profile(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [(1, 10_000 + 100 * k, k, 10.0, 20.0) for k in range(20)]
    schema = "mmsi long, epoch long, seq long, latitude double, longitude double"
    spark.createDataFrame(rows, schema).toPandas().to_parquet(tmp_path / "in" / "0.parquet")
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("epoch"))
    query = run_available(stream_events(sinks.profiled(source, F.col("seq") >= 5, Detection())), str(tmp_path / "out"), str(tmp_path / "state"))
    sinks.write_profile(query.recentProgress, spark, str(tmp_path / "profile"))
    (row,) = spark.read.option("header", True).csv(str(tmp_path / "profile")).collect()
    assert len(row) == 12 and (row["raw_row_count"], row["valid_record_count"], row["vessel_count"], row["ac_sampled_record_count"]) == ("20", "15", "1", "5")


def test_a_step_without_events_builds_no_frames(monkeypatch):
    from vesselwatch.streaming import detector

    class State:
        exists, hasTimedOut, kept = False, False, None

        def update(self, value):
            self.kept = value

    frame, state = pd.DataFrame({"epoch": [1000, 400], "seq": [1, 0], "latitude": [10.0, 10.0], "longitude": [20.0, 20.0], "draught": [5.0, None]}), State()
    step = detector._step(Detection(), None, False)
    monkeypatch.setattr(detector.pd, "DataFrame", None)
    assert list(step((1,), iter([frame]), state)) == []
    assert state.kept == (1000, 10.0, 20.0, 5.0, 1000, 10.0, 20.0, 5.0, 0)
