import csv
import glob

import pytest
from vesselwatch.operators import report, runs
from vesselwatch.sources import sinks


def test_runs_from_folders(spark, tmp_path):
    for name, rows in {"day1_w1_c100": [(0, 50), (10, 70)], "day1_w2_c100": [(0, 60), (5, 90), (6, 80)], "other": [(0, 1)], "day2_w1_c100": [(0, 60), (20, 80)]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "profile.csv").write_text("elapsed_time_sec,total_rss_mb\n" + "".join(f"{a},{b}\n" for a, b in rows))
    samples = runs.read_runs(spark, str(tmp_path / "*" / "profile.csv"))
    totals = runs.run_totals(samples)
    assert sorted(map(tuple, totals.collect())) == [("day1", 1, 100, 10.0, 70.0, 2), ("day1", 2, 100, 6.0, 90.0, 3), ("day2", 1, 100, 20.0, 80.0, 2)]
    speeds = {r["workers"]: r["speedup"] for r in runs.speedups(totals).collect()}
    assert speeds == {1: 1.0, 2: 2.5}
    assert runs.parallel_share(runs.speedups(totals)).first()["parallel_share"] == 1.0
    line = {(r["workers"], r["sample_no"]): (r["mean_mb"], r["deviation_mb"]) for r in runs.mean_timeline(samples).collect()}
    assert line[(1, 1)] == (55.0, 5.0) and len(line) == 5


def test_profile_sink(spark, tmp_path):
    progress = [{"batchId": 1, "numInputRows": 5, "processedRowsPerSecond": None, "durationMs": {"triggerExecution": 7}}, {"batchId": 0, "numInputRows": 9, "processedRowsPerSecond": 2.5, "durationMs": {}}]
    sinks.write_profile(progress, spark, str(tmp_path / "p"))
    (path,) = glob.glob(str(tmp_path / "p/*.csv"))
    assert [(r["chunk_id"], r["raw_row_count"]) for r in csv.DictReader(open(path))] == [("0", "9"), ("1", "5")]


@pytest.mark.parametrize(("lats", "threshold"), [([54.0, 54.5, 57.5], 56.0), ([10.0, 10.2, 10.3], 10.1), ([1.0, 2.0, 3.0], 1.5), ([5.0, 5.0], None)])
def test_latitude_split(spark, lats, threshold):
    df = spark.createDataFrame([(y, y) for y in lats], "start_latitude double, end_latitude double")
    assert report.latitude_split(df).first()["threshold"] == (pytest.approx(threshold) if threshold else None)


def test_top_vessel_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([(2, 10, 20), (2, 0, 5), (1, 3, 4), (1, 9, 9), (3, 1, 1)], "mmsi long, start_ts long, end_ts long")
    got = report.of_top_vessel(df).orderBy("event_index").collect()
    assert [(r["mmsi"], r["start_ts"], r["event_index"]) for r in got] == [(1, 3, 1), (1, 9, 2)]
    assert report.of_top_vessel(df.limit(0)).count() == 0
