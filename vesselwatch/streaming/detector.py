"""Silences, draught changes and jumps over a stream of reports, with state per vessel.

The state holds a vessel's last record and its last track sample. A micro-batch is ordered by time within
each vessel; records not later than the state are late: they are counted in the vessel's state and, if
asked for, returned. On input in order the events equal the batch detectors', however it is cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vesselwatch.config import Detection
from vesselwatch.functions.geo import KM_PER_NAUTICAL_MILE, haversine_km_of
from vesselwatch.operators.tracks import with_quality, without_port_changes
from vesselwatch.session import ship_package

_MEASURES = ["gap_hours", "distance_km", "implied_speed_knots", "start_latitude", "start_longitude", "end_latitude", "end_longitude", "start_draught", "end_draught"]
EVENTS = "mmsi long, kind string, start_epoch long, end_epoch long, " + ", ".join(f"{c} double" for c in _MEASURES)
_NAMES = [c.split()[0] for c in EVENTS.split(", ")]
_POINT = "epoch long, latitude double, longitude double, draught double"
STATE = f"{_POINT}, {', '.join(f'sample_{c}' for c in _POINT.split(', '))}, late long"


_km = haversine_km_of


def _pairs(points: np.ndarray) -> list[np.ndarray]:
    """Neighbouring rows of (epoch, latitude, longitude, draught) as the columns of an event from start_epoch on."""
    a, b = points[:-1], points[1:]
    gap, km = (b[:, 0] - a[:, 0]) / 3600, _km(a[:, 1], a[:, 2], b[:, 1], b[:, 2])
    knots = km / KM_PER_NAUTICAL_MILE / np.where(gap > 0, gap, np.nan)
    return [a[:, 0], b[:, 0], gap, km, knots, a[:, 1], a[:, 2], b[:, 1], b[:, 2], a[:, 3], b[:, 3]]


def _step(config: Detection, forget_s: float | None, with_late: bool):
    """A step works on bare arrays: most groups are a few rows of a vessel, for which a frame's set-up costs more than all the rest."""

    def events(t: np.ndarray, samples: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        """(kinds, columns) of the events found."""
        d, s = _pairs(t), _pairs(samples)
        off = lambda lat, lon: (lat != 0) | (lon != 0)
        fast = (d[1] - d[0] >= config.jump_least_s) & off(d[5], d[6]) & off(d[7], d[8]) & (d[3] > config.jump_km) & (d[4] > config.jump_knots) & (d[2] <= config.jump_h)
        change = np.abs(s[10] - s[9]) / np.where(s[9] > 0, s[9], np.nan)
        silent = (s[2] > config.silence_h) & (s[3] > config.silence_km)
        changed = (s[2] > config.draught_h) & (change > config.draught_share)
        s[4] = np.full(len(s[4]), np.nan)  # no speed
        kinds = [(d, fast, np.where(d[2] <= config.clone_h, "D1", "D2")), (s, silent, np.full(len(silent), "A")), (s, changed, np.full(len(changed), "C"))]
        return [(kind[rows], [c[rows] for c in columns]) for columns, rows, kind in kinds if rows.any()]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (mmsi,) = key
        if state.hasTimedOut:
            state.remove()
            return
        parts = list(frames)
        join = lambda c, kind: np.concatenate([f[c].to_numpy(kind) for f in parts])
        seq, epoch = np.concatenate([f["seq"].to_numpy() for f in parts]), join("epoch", np.int64)
        rows = np.column_stack([epoch, *(join(c, np.float64) for c in ("latitude", "longitude", "draught"))])[np.lexsort((seq, epoch))]
        known = list(state.get) if state.exists else None
        late = rows[:, 0] < known[0] if known else np.zeros(len(rows), bool)
        dropped, rows = rows[late], rows[~late]
        if with_late and len(dropped):
            yield pd.DataFrame({"mmsi": mmsi, "kind": "late", "start_epoch": dropped[:, 0].astype(np.int64), "end_epoch": known[0], "start_latitude": dropped[:, 1], "start_longitude": dropped[:, 2]}).reindex(columns=_NAMES)
        found = []
        if len(rows):
            track = np.vstack([np.array([known[:4]], np.float64), rows]) if known else rows
            bucket = track[:, 0] // config.track_sample_s if config.track_sample_s > 0 else np.arange(len(track))
            first = bucket[1:] != bucket[:-1]
            samples = np.vstack([np.array([known[4:8]], np.float64) if known else track[:1], track[1:][first]])
            found = events(track, samples)
            plain = lambda p: [int(p[0]), *(None if np.isnan(x) else float(x) for x in p[1:])]
            known = [*plain(track[-1]), *plain(samples[-1]), known[8] if known else 0]
        known[8] += len(dropped)
        state.update(tuple(known))
        if forget_s is not None:
            state.setTimeoutTimestamp(max(int((known[0] + forget_s) * 1000), state.getCurrentWatermarkMs() + 1))
        if found:
            start, end, *measures = (np.concatenate(c) for c in zip(*(columns for _, columns in found), strict=True))
            kinds = np.concatenate([kind for kind, _ in found]).astype(object)
            values = [np.full(len(start), mmsi, np.int64), kinds, start.astype(np.int64), end.astype(np.int64), *measures]
            yield pd.DataFrame(dict(zip(_NAMES, values, strict=True)))

    return run


def stream_events(records: DataFrame, config: Detection | None = None, forget_hours: float | None = None, watermark: str = "1 hour", with_late: bool = False) -> DataFrame:
    """Events A, C, D1 and D2 (``kind``) of a streaming DataFrame with mmsi, epoch, seq, latitude, longitude and, for C, draught.

    ``forget_hours``: a vessel's state ends so long after its last record, by the watermark (records older than
    that are dropped and counted by Spark, ``numRowsDroppedByWatermark``); a longer silence is then none. Without it states stay.
    ``with_late``: late records are returned too (kind ``late``, end_epoch: the vessel's last time).
    """
    ship_package(records.sparkSession)
    draught = F.col("draught") if "draught" in records.columns else F.lit(None).cast("double")
    needed = records.select("mmsi", "epoch", "seq", "latitude", "longitude", draught.alias("draught"))
    timeout = GroupStateTimeout.NoTimeout
    if forget_hours is not None:
        needed, timeout = needed.withColumn("ts", F.timestamp_seconds("epoch")).withWatermark("ts", watermark), GroupStateTimeout.EventTimeTimeout
    step = _step(config or Detection(), None if forget_hours is None else forget_hours * 3600, with_late)
    return needed.groupBy("mmsi").applyInPandasWithState(step, EVENTS, STATE, "append", timeout)


def judged(events: DataFrame, config: Detection | None = None, ports: DataFrame | None = None, land: DataFrame | None = None) -> DataFrame:
    """``events`` of a stream (or its results) after the look-ups: draught changes at sea only, jumps with their quality.

    The catalogues are static, so this holds for a streaming DataFrame as for a stored one.
    """
    config = config or Detection()
    start = F.struct(F.col("start_latitude").alias("latitude"), F.col("start_longitude").alias("longitude"))
    is_jump = F.col("kind").isin("D1", "D2")
    t = events.withColumns({"prev": start, "sample": start, "latitude": F.col("end_latitude"), "longitude": F.col("end_longitude"), "is_draught_change": F.col("kind") == "C", "subtype": F.when(is_jump, F.col("kind"))})
    t = with_quality(without_port_changes(t, config, ports), config, ports, land)
    kept = t.where((F.col("kind") != "C") | F.col("is_draught_change")).withColumn("counts", F.when(is_jump, F.col("counts")))
    return kept.select(*events.columns, "start_on_land", "end_on_land", "quality_flag", "counts")


def run_available(stream: DataFrame, path: str, checkpoint: str):
    """Process what there is and append the events to Parquet at ``path``; repeated runs go on where the last one ended."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query
