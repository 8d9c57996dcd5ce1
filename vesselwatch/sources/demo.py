"""Position reports, ports and a land mask derived from the driver's tables.

Nothing in those tables is vessel data; ``events`` becomes reports (a user is a vessel) and the first nations
become ports. The texts are valid in Spark and DuckDB alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselwatch.sources.tables import land_from_rings

COORDINATES = """
  54e0 + (user_id % 8) * 4e-1 + (event_id % 7) * 3e-4 + case when event_id % 17 = 0 then 3e0 else 0e0 end as latitude,
  8e0 + (user_id % 8) * 6e-1 + (event_id % 5) * 3e-4 as longitude"""
MEASURES = """
  case when event_id % 19 = 0 then null else (event_id % 23) * 1e-1 end as sog,
  case when event_type = 'error' then null else 6e0 + (event_id % 5) * 2e-1 end as draught"""
RECORDS = f"""select cast(200000000 + user_id as bigint) as mmsi, date_trunc('second', ts) as ts, event_id as seq,{COORDINATES},{MEASURES} from events"""
#: Forty vessels in tens of berths, a report every ten minutes: meetings within minutes, at a latitude where the plain grid misses some.
BERTHS = """select cast(210000000 + event_id % 40 as bigint) as mmsi, cast(floor(event_id / 40e0) as bigint) * 600 as epoch_s, event_id as seq,
  54e0 + floor(event_id % 40 / 4e0) * 5e-1 + (event_id % 3) * 1e-4 as latitude,
  8e0 + floor(event_id % 40 / 4e0) * 6e-1 + (event_id % 4) * 24e-4 + (event_id % 7) * 1e-4 + case when (cast(floor(event_id / 800e0) as bigint) + event_id % 40) % 5 = 0 then 5e-2 else 0e0 end as longitude,
  case when event_id % 23 = 0 then 2e0 else (event_id % 9) * 1e-1 end as sog, cast(null as double) as draught from events"""
PORTS = "select n_nationkey as port_no, n_name as port_name, 54e0 + n_nationkey * 4e-1 as latitude, 8e0 + n_nationkey * 6e-1 as longitude, 3e0 as radius_km from nation where n_nationkey < 3"
#: Sixty directions, on a diamond rather than a circle so that they are plain fractions.
CIRCLE = [((1 - abs(k - 30) / 15) if k <= 60 else 0.0, 1 - abs(((k + 45) % 60) - 30) / 15) for k in range(60)]
#: Two rectangles of land: (longitude, latitude) corners, north of all unshifted positions.
LAND = [[[(0.0, 56.9), (8.9, 56.9), (8.9, 80.0), (0.0, 80.0)]], [[(10.9, 56.9), (60.0, 56.9), (60.0, 80.0), (10.9, 80.0)]]]
#: A coast with a lake in it, an island across longitude 180 (its longitudes go on beyond it), and two that overlap.
COAST = [
    [[(8 + (9 + 3 * ((k * 37) % 11) / 11) * x, 55 + (6 + 2 * ((k * 53) % 7) / 7) * y) for k, (x, y) in enumerate(CIRCLE)], [(9 + 2 * x, 55 + y) for x, y in CIRCLE[::3]]],
    [[(179 + (4 + ((k * 29) % 5) / 5) * x, 10 + 3 * y) for k, (x, y) in enumerate(CIRCLE)]],
    [[(-60.0, -20.0), (-40.0, -20.0), (-40.0, 0.0), (-60.0, 0.0)]],
    [[(-50.0, -10.0), (-30.0, -10.0), (-30.0, 10.0)]],
]
LAND_SQL = "({lat} > 56.9e0 and ({lon} < 8.9e0 or {lon} > 10.9e0))"


def _view(spark: SparkSession, sf_dir: str, name: str, text: str) -> DataFrame:
    return spark.sql(text.replace(f"from {name}", "from {src}"), src=spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", RECORDS)


def berths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", BERTHS).withColumn("ts", F.timestamp_seconds("epoch_s"))


def ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "nation", PORTS)


def land(spark: SparkSession) -> DataFrame:
    return land_from_rings(spark, LAND)


#: Positions all over the earth, a third of them near the coast.
POSITIONS = """select event_id as seq, case when event_id % 3 = 0 then 46e0 + (event_id * 37 % 1800) / 100e0 else (event_id * 37 % 1700) / 10e0 - 85e0 end as latitude,
  case when event_id % 3 = 0 then -5e0 + (event_id * 73 % 2600) / 100e0 else (event_id * 73 % 3600) / 10e0 - 180e0 end as longitude from events"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", POSITIONS)


def coast(spark: SparkSession) -> DataFrame:
    return land_from_rings(spark, COAST)


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows in the input format, some broken in each possible way (by the event's number)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.date_trunc("second", "ts"))
    k = F.col("event_id")
    stamp = F.when(k % 11 == 0, F.date_format("ts", "d/M/yyyy H:m")).when(k % 13 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
    mmsi = (F.lit(200000000) + F.col("user_id")).cast("long").cast("string")
    return e.select(
        k.alias("event_id"), F.lit(0).alias("file_no"), k.alias("row_no"), stamp.alias("raw_time"),
        F.when(k % 5 == 0, "Class B").when(k % 7 == 0, "  Class A ").otherwise("Class A").alias("raw_type"),
        F.when(k % 29 == 0, "111111111").when(k % 31 == 0, F.concat(mmsi, F.lit(".0"))).when(k % 37 == 0, F.concat(mmsi, F.lit(".5"))).otherwise(mmsi).alias("raw_mmsi"),
        F.when(k % 41 == 0, "95").when(k % 43 == 0, "0").when(k % 47 == 0, "nan").otherwise((50 + k % 9).cast("string")).alias("raw_latitude"),
        F.when(k % 53 == 0, "-200.5").when(k % 43 == 0, "0.0").otherwise((k % 100).cast("string")).alias("raw_longitude"),
        F.when(k % 3 == 0, "Unknown").otherwise((k % 23).cast("string")).alias("raw_sog"),
        F.when(k % 4 == 0, "").when(k % 9 == 0, "abc").otherwise((k % 10).cast("string")).alias("raw_draught"),
    )


RAW = """select event_id,
  case when event_id % 11 = 0 then strftime(date_trunc('second', ts), '%-d/%-m/%Y %-H:%-M') when event_id % 13 = 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') else strftime(ts, '%d/%m/%Y %H:%M:%S') end as raw_time,
  case when event_id % 5 = 0 then 'Class B' when event_id % 7 = 0 then '  Class A ' else 'Class A' end as raw_type,
  case when event_id % 29 = 0 then '111111111' when event_id % 31 = 0 then (200000000 + user_id)::varchar || '.0' when event_id % 37 = 0 then (200000000 + user_id)::varchar || '.5' else (200000000 + user_id)::varchar end as raw_mmsi,
  case when event_id % 41 = 0 then '95' when event_id % 43 = 0 then '0' when event_id % 47 = 0 then 'nan' else (50 + event_id % 9)::varchar end as raw_latitude,
  case when event_id % 53 = 0 then '-200.5' when event_id % 43 = 0 then '0.0' else (event_id % 100)::varchar end as raw_longitude,
  case when event_id % 3 = 0 then 'Unknown' else (event_id % 23)::varchar end as raw_sog,
  case when event_id % 4 = 0 then '' when event_id % 9 = 0 then 'abc' else (event_id % 10)::varchar end as raw_draught
from events"""
