import pytest
from pyspark.sql import functions as F
from vesselwatch.functions import clean
from vesselwatch.sources import tables

BASE = {"raw_time": "01/09/2025 12:34:56", "raw_type": "Class A", "raw_mmsi": "223456789", "raw_latitude": "10.5", "raw_longitude": "20.5", "raw_sog": "7.2", "raw_draught": "8.5"}


def rows(spark, *changes):
    data = [(0, k, *(BASE | c).values()) for k, c in enumerate(changes)]
    return spark.createDataFrame(data, "file_no int, row_no long, " + ", ".join(f"{c} string" for c in BASE))


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None), ({"raw_time": "1/9/2025 12:34"}, None), ({"raw_time": " 01/09/2025   12:34:56 "}, None), ({"raw_type": " Class A "}, None),
        ({"raw_type": "Class B"}, "type"), ({"raw_type": None}, "type"), ({"raw_time": "2025-09-01 12:34:56"}, "time"), ({"raw_time": "31/02/2025 10:00"}, "time"),
        ({"raw_mmsi": "111111111"}, "mmsi"), ({"raw_mmsi": "123456789"}, "mmsi"), ({"raw_mmsi": "12345678"}, "mmsi"), ({"raw_mmsi": "1234567890"}, "mmsi"), ({"raw_mmsi": "0"}, "mmsi"),
        ({"raw_mmsi": "223456789.0"}, None), ({"raw_mmsi": "223456789.5"}, "mmsi"), ({"raw_mmsi": "2.23456789e8"}, None), ({"raw_latitude": "100"}, "latitude"), ({"raw_latitude": "nan"}, "latitude"),
        ({"raw_longitude": "200"}, "longitude"), ({"raw_latitude": "0", "raw_longitude": "0.0"}, "origin"), ({"raw_latitude": None}, "latitude"), ({"raw_latitude": "1.0d"}, "latitude"),
    ],
)
def test_reject_reasons(spark, change, reason):
    assert tables.typed(rows(spark, change)).select(tables.reject_reason().alias("r")).first()["r"] == reason


def test_optional_values(spark):
    got = tables.valid_records(rows(spark, {"raw_sog": ""}, {"raw_draught": "NULL"}, {"raw_draught": "abc"}, {"raw_draught": " Undefined "}, {})).orderBy("seq").collect()
    assert [(r["sog"], r["draught"]) for r in got] == [(None, 8.5), (7.2, None), (7.2, None), (7.2, None), (7.2, 8.5)]
    assert got[0]["mmsi"] == 223456789


def test_text_helpers(spark):
    df = spark.createDataFrame([("\t x ",), ("  ",), (None,), ("n/a",)], "c string")
    assert [r[0] for r in df.select(clean.trimmed(F.col("c"))).collect()] == ["x", None, None, "n/a"]
    assert [r[0] for r in df.select(clean.present(F.col("c"))).collect()] == ["x", "", None, ""]


def test_csv_oddities(spark, tmp_path):
    head = "# Timestamp,Type of mobile,MMSI,Latitude,Longitude,SOG,Draught,Extra"
    (tmp_path / "a.csv").write_text(head + '\n01/09/2025 12:34:56,Class A,223456789,10.5,20.5,7.2,8.5,"x, ""y"""\n\n01/09/2025 12:35:56,Class A,223456789,10.5\n')
    (tmp_path / "b.csv").write_text("Draught,SOG,Longitude,Latitude,MMSI,Type of mobile,# Timestamp\n8.5,7.2,20.5,10.5,223456780,Class A,01/09/2025 12:34\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text(head + "\n")
    raw = tables.read_raw(spark, [str(tmp_path / f) for f in ("a.csv", "empty.csv", "head.csv", "b.csv")])
    assert raw.count() == 3
    assert [(r["mmsi"], r["longitude"]) for r in tables.valid_records(raw).orderBy("seq").collect()] == [(223456789, 20.5), (223456780, 20.5)]
    (tmp_path / "bad.csv").write_text("MMSI,SOG\n1,2\n")
    with pytest.raises(ValueError, match="# Timestamp, Draught, Latitude"):
        tables.read_raw(spark, str(tmp_path / "bad.csv"))
