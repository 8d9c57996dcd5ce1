"""CSV files as a stream, replays, pairs with keyed state, and the profile of a whole stream."""

import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from vesselwatch.config import Detection
from vesselwatch.operators import meetings, tracks
from vesselwatch.sources import sinks, tables
from vesselwatch.streaming.detector import run_available, stream_events
from vesselwatch.streaming.pairs import POINTS, last_point, run_meetings
from vesselwatch.streaming.reports import record_stream, report_stream

START = datetime(2025, 1, 1)
HEADER = ["# Timestamp", "Note", "MMSI", "Latitude", "Longitude", "SOG", "Draught", "Type of mobile"]


def _line(k: int, mmsi: int) -> str:
    at = START + timedelta(minutes=37 * k + (600 if k % 40 == 0 else 0))
    lat = "95" if k % 17 == 0 else f"{10 + (k * 7 % 11) * 0.4:.1f}"
    return f'{at:%d/%m/%Y %H:%M:%S},"a, ""b""",{mmsi},{lat},20,{"" if k % 5 else "1.5"},8,{"Class B" if k % 13 == 0 else "Class A"}'


def _write(path, lines):
    path.write_text(",".join(HEADER) + "\n" + "\n".join(lines) + "\n")


def test_csv_stream_gives_the_batch_events_and_drops_replays(spark, tmp_path):
    lines = [_line(k, 223456780 + k % 3) for k in range(300)]
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    for k in range(3):
        _write(source / f"day{k}.csv", lines[k * 100 : (k + 1) * 100])
        if k == 1:
            shutil.copy(source / "day1.csv", source / "day1-again.csv")
        records = record_stream(report_stream(spark, str(source), HEADER, files_per_batch=1), replay="30 days")
        run_available(stream_events(records), out, state)
    (tmp_path / "empty.csv").write_text("")
    batch = tables.valid_records(tables.read_raw(spark, [str(source / f"day{k}.csv") for k in range(3)]))
    found = tracks.candidates(batch)
    epochs = [F.unix_seconds("start_ts").alias("start_epoch"), F.unix_seconds("end_ts").alias("end_epoch")]
    want = tracks.jumps(tracks.with_quality(found, Detection(), None, None)).select("mmsi", F.col("subtype").alias("kind"), *epochs)
    want = want.union(tracks.silences(found).select("mmsi", F.lit("A"), *epochs)).union(tracks.draught_changes(found).select("mmsi", F.lit("C"), *epochs))
    got = spark.read.parquet(out).select("mmsi", "kind", "start_epoch", "end_epoch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20


def test_headers_are_bound_by_name(spark, tmp_path):
    with pytest.raises(ValueError, match="missing columns: MMSI"):
        report_stream(spark, str(tmp_path), [h for h in HEADER if h != "MMSI"])
    source = tmp_path / "in"
    source.mkdir()
    _write(source / "a.csv", [_line(1, 223456780)])
    stream = report_stream(spark, str(source))  # the header of what is there
    assert stream.columns == list(tables.COLUMNS.values())
    run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).first()["raw_mmsi"] == "223456780"
    (source / "b.csv").write_text(",".join(reversed(HEADER)) + "\nClass A,8,1,20,10,223456780,x,01/01/2025 00:00:00\n")
    with pytest.raises(Exception, match="header"):
        run_available(report_stream(spark, str(source), HEADER), str(tmp_path / "out"), str(tmp_path / "state"))


def _points(seed=5):
    rng = random.Random(seed)
    rows = []
    for b in range(60):
        if rng.random() < 0.25:
            continue
        for v in range(6):
            if rng.random() < 0.8:
                rows.append((v, 300 * b, 10 + (v // 2) * 0.5 + rng.random() * 0.003, 20.0 + rng.random() * 0.003, len(rows)))
    return rows


@pytest.mark.parametrize("cut", ["in order", "mixed"])
def test_keyed_meetings_equal_the_strict_batch(spark, tmp_path, cut):
    config = Detection(meeting_h=0.5, meeting_gap_s=900, meeting_sample_s=300)
    rows = _points()
    want = meetings.meeting_sessions(meetings.pair_observations(spark.createDataFrame(rows, POINTS), config), spark.createDataFrame(rows, POINTS), config, strict_gap=True)
    want = want.where(F.col("duration_hours") >= 0.5).drop("session")
    if cut == "mixed":  # up to ten buckets late
        rows = sorted(rows, key=lambda r, rng=random.Random(9): r[1] + rng.randrange(3000))
    (tmp_path / "in").mkdir()
    sizes = [0, 40, 130, len(rows)]
    for k, (a, b) in enumerate(zip(sizes[:-1], sizes[1:], strict=True)):
        spark.createDataFrame(rows[a:b], POINTS).toPandas().to_parquet(tmp_path / "in" / f"{k}.parquet")
        run_meetings(spark.readStream.schema(POINTS).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), config, delay="3100 seconds")
    early = spark.read.parquet(str(tmp_path / "out")).count()
    last_point(spark, 10**6).toPandas().to_parquet(tmp_path / "in" / "last.parquet")
    query = run_meetings(spark.readStream.schema(POINTS).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), config, delay="3100 seconds")
    rows_of = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(sorted(want.columns)).collect())
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(want) and want.count() > 3
    assert cut == "mixed" or early > 0
    left = {s["operatorName"]: s["numRowsTotal"] for s in query.lastProgress["stateOperators"]}
    assert left["transformWithStateInPandasExec"] == 0  # closed pairs have left the state


def test_every_micro_batch_is_in_the_profile(spark, tmp_path):
    schema = "mmsi long, epoch long, seq long, latitude double, longitude double"
    (tmp_path / "in").mkdir()
    for k in range(15):
        spark.createDataFrame([(1, 10_000 + 100 * k, k, 10.0, 20.0)], schema).toPandas().to_parquet(tmp_path / "in" / f"{k:03d}.parquet")
    log = sinks.ProgressLog(spark, str(tmp_path / "progress"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "4")  # so many Spark keeps
    try:
        query = run_available(source, str(tmp_path / "out"), str(tmp_path / "state"))
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    log.stop()
    assert len(query.recentProgress) <= 4
    sinks.write_profile(str(tmp_path / "progress"), spark, str(tmp_path / "profile"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "profile")).collect()
    assert [int(r["chunk_id"]) for r in rows] == list(range(15)) and all(r["raw_row_count"] == "1" for r in rows)


def test_numbered_reports_of_one_time_keep_their_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [",".join(["Number", *HEADER])]
    for v in range(8):
        for number, (hour, lat) in enumerate([(1, 10 + v), (1, 30 + v), (1, 10 + v), (9, 50)]):
            value = {"# Timestamp": f"01/01/2025 0{hour}:00:00", "Type of mobile": "Class A", "MMSI": str(210000001 + v), "Latitude": str(lat), "Longitude": "10", "SOG": "1", "Draught": "5"}
            lines.append(",".join([str(10 * v + number), *(value.get(h, "") for h in HEADER)]))
    (tmp_path / "in/a.csv").write_text("\n".join([lines[0], *reversed(lines[1:])]) + "\n")
    records = record_stream(report_stream(spark, str(tmp_path / "in"), ["Number", *HEADER], number="Number"), replay="1 day")
    run_available(stream_events(records), str(tmp_path / "out"), str(tmp_path / "state"))
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    # a sample is the first report of its time, a jump starts at the last one, which is no repetition of the first
    assert {(r["mmsi"] - 210000001, r["start_latitude"]) for r in found if r["kind"] == "A"} == {(v, 10.0 + v) for v in range(8)}
    assert {(r["mmsi"] - 210000001, r["start_latitude"]) for r in found if r["kind"] == "D2"} == {(v, 10.0 + v) for v in range(8)}


def test_a_pair_s_observations_take_few_calls_of_the_state(spark):
    from unittest.mock import MagicMock

    import pandas as pd
    from vesselwatch.streaming.pairs import PairMeetings

    handle, n = MagicMock(), 200
    pair = PairMeetings(1500, 2.0, 300)
    pair.init(handle)
    rows = {"bucket": [300 * k for k in range(n)], "km": [0.1] * n, "seq_a": range(n), "seq_b": range(n)} | {c: [1.0] * n for c in ("lat_a", "lon_a", "lat_b", "lon_b")}
    assert list(pair.handleInputRows((1, 2), iter([pd.DataFrame(rows)]), None)) == []
    assert handle.registerTimer.call_count == 1
    assert sum(len(state.method_calls) for state in (pair.pending, pair.open)) <= 2
