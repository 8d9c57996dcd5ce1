import csv
import glob
import struct

import pytest
from vesselwatch import cli

HEAD = "# Timestamp,Type of mobile,MMSI,Latitude,Longitude,SOG,Draught\n"


def test_end_to_end(spark, tmp_path, capsys):
    lines = [
        "01/09/2025 00:00:00,Class A,223456789,10,20,5,8", "01/09/2025 06:00:00,Class A,223456789,10.5,20,5,9", "01/09/2025 06:10:00,Class A,223456789,12.5,20,5,9",
        "01/09/2025 00:00:00,Class A,223456780,0.5,20,0.1,8", "01/09/2025 01:00:00,Class A,223456780,0.5,20,0.1,8", "01/09/2025 01:00:00,Class A,111111111,0.5,20,0.1,8",
    ]
    (tmp_path / "in.csv").write_text(HEAD + "\n".join(lines) + "\n")
    (tmp_path / "ports.csv").write_text("port_name,country,latitude,longitude,radius_km\nX,XX, 50 ,60,3\n")
    cli.main([str(tmp_path / "in.csv"), "--ports", str(tmp_path / "ports.csv"), "--out", str(tmp_path / "out"), "--top", "1"])
    assert "223456789" in capsys.readouterr().out
    (path,) = glob.glob(str(tmp_path / "out/vessels/*.csv"))
    rows = list(csv.DictReader(open(path)))
    assert [(r["MMSI"], r["DFSI"], r["record_count"], r["going_dark_events"], r["teleportation_d1_events"]) for r in rows] == [("223456789", "38.000000", "3", "1", "1"), ("223456780", "0.000000", "2", "0", "0")]
    (path,) = glob.glob(str(tmp_path / "out/jumps_d1/*.csv"))
    assert list(csv.DictReader(open(path)))[0]["point_a_timestamp"] == "2025-09-01T06:00:00"


@pytest.mark.parametrize("change", [["--top", "0"], ["--track-seconds", "-1"], ["--ports", "/nowhere.csv"], []])
def test_input_guards(spark, tmp_path, change):
    (tmp_path / "in.csv").write_text(HEAD if change else "MMSI\n1\n")
    with pytest.raises(SystemExit):
        cli.main([str(tmp_path / "in.csv"), "--out", str(tmp_path / "out"), *change])
    with pytest.raises(SystemExit):
        cli.main([str(tmp_path / "missing.csv"), "--out", str(tmp_path / "out")])


def test_quoted_line_ends_and_a_shapefile(spark, tmp_path):
    """A field of two lines; a mask in which one end of the jump lies."""
    head = "# Timestamp,Type of mobile,MMSI,Latitude,Longitude,SOG,Draught,Name\n"
    lines = ['01/09/2025 00:00:00,Class A,223456789,10.2,20.2,5,8,"a\nb"', '01/09/2025 02:00:00,Class A,223456789,14.2,20.2,5,8,"""x""\n"', "01/09/2025 04:00:00,Class A,223456789,18.2,20.2,5,8,z"]
    (tmp_path / "in.csv").write_text(head + "\n".join(lines) + "\n")
    ring = [(20.0, 10.0), (20.5, 10.0), (20.5, 10.5), (20.0, 10.5), (20.0, 10.0)]
    body = struct.pack("<i4d2i", 5, 20, 10, 20.5, 10.5, 1, 5) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "land.shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 0) + bytes(72) + struct.pack(">2i", 1, len(body) // 2) + body)
    cli.main([str(tmp_path / "in.csv"), "--land", str(tmp_path / "land.shp"), "--multi-line", "--out", str(tmp_path / "out")])
    (path,) = glob.glob(str(tmp_path / "out/jumps_d2/*.csv"))
    (row,) = csv.DictReader(open(path))
    assert (row["point_a_timestamp"], row["point_a_on_land"], row["point_b_on_land"], row["quality_flag"]) == ("2025-09-01T02:00:00", "false", "false", "ok")
    (path,) = glob.glob(str(tmp_path / "out/vessels/*.csv"))
    (row,) = csv.DictReader(open(path))
    assert (row["teleportation_d2_valid_events"], row["teleportation_d2_flagged_events"]) == ("1", "1")  # the first jump began on land
