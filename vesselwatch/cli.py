"""Command line: reads report files, writes the vessel table and the map tables as CSV."""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from vesselwatch.config import LIMITS, Detection
from vesselwatch.operators import report
from vesselwatch.plans.detection import run_detection
from vesselwatch.session import get_session, stored
from vesselwatch.sources import sinks, tables
from vesselwatch.sources.shapes import read_shapefile


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vesselwatch", description=__doc__)
    p.add_argument("reports", nargs="+", help="CSV files of position reports, in time order")
    p.add_argument("--ports", help="CSV catalogue of ports")
    p.add_argument("--land", help="land polygons: a shapefile (.shp), GeoJSON, or JSON lines of edges")
    p.add_argument("--out", required=True, help="folder for the CSV tables")
    p.add_argument("--top", type=int, default=10, help="vessels to print")
    p.add_argument("--encoding", default="utf-8")
    p.add_argument("--multi-line", action="store_true", help="quoted fields may hold line ends (files are then not split)")
    p.add_argument("--no-meetings", action="store_true", help="leave out detector B")
    p.add_argument("--exact-grid", action="store_true", help="find meetings at high latitudes too")
    p.add_argument("--strict-gap", action="store_true", help="end a meeting after any long gap")
    p.add_argument("--track-seconds", type=int, default=LIMITS["track_sample_s"])
    p.add_argument("--meeting-seconds", type=int, default=LIMITS["meeting_sample_s"])
    p.add_argument("--slice-seconds", type=int, help="cut tracks into slices, for vessels with very many records")
    p.add_argument("--master", help="Spark master")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.top <= 0:
        raise SystemExit("--top must be positive")
    spark = get_session(master=args.master)
    try:
        config = Detection(track_sample_s=args.track_seconds, meeting_sample_s=args.meeting_seconds)
        raw = tables.read_raw(spark, args.reports, args.encoding, args.multi_line)
        ports = tables.read_ports(spark, args.ports) if args.ports else None
        read_land = read_shapefile if args.land and args.land.lower().endswith(".shp") else tables.read_land
        land = read_land(spark, args.land) if args.land else None
    except (ValueError, AnalysisException) as e:  # limits, missing columns, missing files
        raise SystemExit(str(e)) from e
    # parsed once, each kind of event found once, whatever the number of reports
    records = stored(tables.valid_records(raw), "records")
    found = run_detection(records, ports, land, config, not args.no_meetings, args.exact_grid, args.strict_gap, args.slice_seconds).kept()
    ranked = stored(found.ranked(), "vessels")
    sinks.write_vessels(ranked, f"{args.out}/vessels")
    sinks.write_map_table(report.silence_map(found.silences), sinks.SILENCES, f"{args.out}/silences")
    for name, subtype in (("jumps", None), ("jumps_d1", "D1"), ("jumps_d2", "D2")):
        sinks.write_map_table(report.jump_map(found.jumps, subtype), sinks.JUMPS, f"{args.out}/{name}")
    if not args.no_meetings:
        sinks.write_map_table(report.meeting_map(found.meetings), sinks.MEETINGS, f"{args.out}/meetings")
    ranked.where(F.col("rank") <= args.top).orderBy("rank").select("rank", "mmsi", "score", "record_count").show(args.top, truncate=False)


if __name__ == "__main__":
    main()
