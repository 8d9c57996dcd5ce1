"""Position reports as a stream: CSV files that arrive in a folder, parsed and checked as in the batch; replays are dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselwatch.sources import tables

#: What makes two reports the same one.
SAME = ["mmsi", "ts", "latitude", "longitude", "sog", "draught"]


def report_stream(spark: SparkSession, path: str, header: Sequence[str] | None = None, files_per_batch: int | None = None, encoding: str = "utf-8", multi_line: bool = False, number: str | None = None) -> DataFrame:
    """Seven text columns of CSV files in ``path``, bound by header name, as a stream.

    ``header``: the column names in their order; by default those of the files that are there. A file with another header
    stops the stream rather than being misread. A needed column that is missing raises ValueError. ``files_per_batch`` bounds a
    micro-batch. Rows have no numbers in a stream: reports of one vessel and second are told apart by their content, and ordered by
    a hash of it, unless a column of the files numbers them (``number``, its header name; becomes ``raw_number``).
    """
    options = {"header": True, "escape": '"', "encoding": encoding, "multiLine": multi_line}
    columns = list(header) if header is not None else spark.read.options(inferSchema=False, **options).csv(path).columns
    if missing := sorted(n for n in tables.COLUMNS if tables.header_column(columns, n) is None):
        raise ValueError(f"{path}: missing columns: {', '.join(missing)}")
    repeated = any(c not in columns or columns.count(c) > 1 for c in (tables.header_column(columns, n) for n in tables.COLUMNS)) or any(tables.header_column(columns, n) != n for n in tables.COLUMNS)
    reader = spark.readStream.options(enforceSchema=repeated, **options).schema(", ".join(f"`{c.replace('`', '``')}` string" for c in columns))
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    numbers = [] if number is None else [F.col(f"`{number.replace('`', '``')}`").alias("raw_number")]
    return reader.csv(path).select(*numbers, *(F.col(f"`{tables.header_column(columns, n)}`").alias(ours) for n, ours in tables.COLUMNS.items()))


def record_stream(raw: DataFrame, replay: str | None = "1 day") -> DataFrame:
    """(mmsi, ts, epoch, seq, latitude, longitude, sog, draught) of the rows that pass all checks.

    ``replay``: a report that comes again while the watermark is no further than this behind its time is dropped (a file delivered
    twice, an overlapping export); reports older than that are dropped as late. None: nothing is dropped.
    Of numbered reports (``raw_number``) ``seq`` is the number, and those with different numbers are different ones.
    """
    numbered = "raw_number" in raw.columns
    order = F.col("raw_number").try_cast("long") if numbered else F.xxhash64(*tables.COLUMNS.values())
    valid = tables.typed(raw.where(tables.clean.valid_mobile_type(F.col("raw_type")))).where(tables.reject_reason().isNull())
    valid = valid.select("mmsi", "ts", F.unix_seconds("ts").alias("epoch"), order.alias("seq"), "latitude", "longitude", "sog", "draught")
    return valid if replay is None else valid.withWatermark("ts", replay).dropDuplicatesWithinWatermark([*SAME, *(["seq"] if numbered else [])])
