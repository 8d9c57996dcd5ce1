"""Pairs and sessions of crowded points without a row for each pair in any shuffle.

Where many vessels lie close together, the close pairs are far more than the points. Vessels are dealt to ranges of their numbers;
every two ranges are a group, which gets all points of both, in all buckets. A pair is in one group only, so its
sessions are found there: what is shuffled are points, one copy for each range. Pairs of single buckets are found in groups of a bucket, or of some,
so that there are hardly ever ranges. Ranges go by the number of points that a task can hold, not by that of pairs. Within a group points meet by sorted
cells, some vessels at a time, so that memory is bounded by ``CANDIDATES``.

Where only the number of a vessel's sessions is asked for, sessions aren't listed either: a group gets a row for each vessel and tells one.
The buckets that a vessel spends at a place are the bits of a number there, and those of a pair the bits that both have (``_counts``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vesselwatch.config import Detection
from vesselwatch.functions.geo import EARTH_RADIUS_KM, grid_degrees, haversine_km_of
from vesselwatch.session import ship_package

#: Comparisons at a time within a group.
CANDIDATES = 2_000_000
#: Comparisons of a group, about. Groups are large, so that points have few copies; memory goes by ``RANGE_POINTS`` and what is compared at a time.
LISTED = 4_000_000_000
#: The same where sessions are only counted. At a time: pairs.
COUNTED, COUNTED_AT_A_TIME = 400_000_000, 1 << 16
#: Groups for each core, about.
GROUPS_PER_CORE = 3
#: Places are cells, cut into so many each way.
CUTS = 4
#: Buckets of a number, and beginnings that one must be able to hold if there are more buckets.
BITS, LEAST_STARTS = 64, 8
#: Buckets of a vessel in a row, at most.
ROW_BUCKETS = 4096
#: Points of a range of vessels, about.
RANGE_POINTS = 500_000
#: Ranges that vessels are dealt to, at most.
RANGES = 400
#: Slices of buckets that pairs are looked for in, at most; a bucket each, if there are no more.
SLICES = 2000
#: Pairs within cells from which on they may be too many to be shuffled.
LEAST_PAIRS = 1_000_000

PAIRS = "mmsi_a long, mmsi_b long, bucket long, latitude_a double, longitude_a double, latitude_b double, longitude_b double, km double"
_PLACES = ["lat_a", "lon_a", "lat_b", "lon_b"]
COUNTS = "mmsi long, n long"
#: Sessions of which only those are wanted that end from the first bucket on (None: whichever) and before the second.
Ends = tuple[int | None, int | None] | None
#: The occupied bucket before the first.
NEVER = -(1 << 62)
SESSIONS = (
    "mmsi_a long, mmsi_b long, start_epoch long, end_epoch long, duration_hours double, observations long, min_distance_km double, avg_distance_km double, "
    + ", ".join(f"{side}_{c} double" for side in ("start", "end") for c in _PLACES)
)
_ROWS_OUT = 200_000
#: Pairs whose observations are taken from their bits at a time.
_PAIRS_OUT = 1 << 14


def ranges_for(points: DataFrame, config: Detection, candidates: int | None = None, by_bucket: bool = False) -> list[int] | None:
    """The first vessel of each range but the first, if pairs are so many that groups of ranges are less work than shuffling pairs; else None.

    Pairs are judged by the squares of the cells' sizes. ``candidates``: comparisons of a group, about. ``by_bucket``: groups are cut by bucket, too.
    """
    size, parallel = grid_degrees(config.meeting_km), points.sparkSession.sparkContext.defaultParallelism
    cells = points.groupBy("bucket", F.floor(F.col("latitude") / size).alias("y"), F.floor(F.col("longitude") / size).alias("x")).agg(F.count("*").alias("n"))
    buckets = cells.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    n, squares, most, slices = buckets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("squares"), F.lit(0.0)), F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    if by_bucket:
        k = max(1, math.ceil((most + n / SLICES * (slices > SLICES)) / RANGE_POINTS))
        least = math.ceil(math.sqrt(2 * GROUPS_PER_CORE * parallel / max(1, min(slices, SLICES))))
    else:
        k = max(1, math.ceil(math.sqrt(2 * squares / (candidates or LISTED))), math.ceil(n / RANGE_POINTS))
        least = math.ceil(math.sqrt(2 * GROUPS_PER_CORE * parallel))
    if squares < LEAST_PAIRS or k > RANGES or n * (k + 1) >= squares:
        return None
    if n * (least + 1) < squares:
        k = max(k, least)
    if k == 1:
        return []
    (found,) = points.agg(F.percentile_approx("mmsi", [i / k for i in range(1, k)], 10_000)).first()
    return sorted({int(m) for m in found})


def _usable(points: DataFrame) -> DataFrame:
    return points.where("mmsi is not null and bucket is not null and not isnan(latitude) and not isnan(longitude) and latitude is not null and longitude is not null")


def _dealt(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """Each row for all groups (i, j) of its vessel's range; ``side``: 0 the first range, 1 the second, 2 both."""
    own = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("mmsi"))) if bounds else F.lit(0)
    group = F.transform(F.sequence(F.lit(0), F.lit(len(bounds))), lambda o: F.struct(F.least(o, "own").alias("i"), F.greatest(o, "own").alias("j"), F.when(o == F.col("own"), 2).when(o > F.col("own"), 0).otherwise(1).alias("side")))
    return rows.withColumn("own", own).withColumn("g", F.explode(group)).select(F.expr("cast(g.j * (g.j + 1) / 2 as int) + g.i").alias("group"), "g.side", *rows.columns)


def _by_group(dealt: DataFrame, bounds: list[int]) -> DataFrame:
    # by their numbers groups are dealt evenly; few bytes but many comparisons: adaptive execution, which goes by bytes, must not put these partitions together
    groups = _groups(bounds)
    return dealt.repartitionById(groups, "group") if groups <= 2000 else dealt.repartition(2000, "group")


def _groups(bounds: list[int]) -> int:
    return (len(bounds) + 1) * (len(bounds) + 2) // 2


def _grouped(points: DataFrame, bounds: list[int]) -> DataFrame:
    """A row for each point in each group of its slice."""
    # of several points of a vessel in a bucket the order matters, not what it is made of
    ties = F.row_number().over(Window.partitionBy("mmsi", "bucket").orderBy("seq")).cast("long").alias("tie")
    dealt = _dealt(_usable(points).select("mmsi", "bucket", "latitude", "longitude", ties), bounds)
    few = [r["bucket"] for r in points.select("bucket").where("bucket is not null").distinct().limit(SLICES + 1).collect()]
    if len(few) <= SLICES and (n := len(few) * _groups(bounds)) <= 2 * SLICES:  # each its own partition: dealt evenly
        number = F.array_position(F.array(*[F.lit(b).cast("long") for b in sorted(few)]), F.col("bucket")) - 1
        return dealt.withColumn("group", (number * _groups(bounds) + F.col("group")).cast("int")).repartitionById(max(1, n), "group")
    number = F.pmod(F.xxhash64("bucket"), F.lit(SLICES))
    return dealt.withColumn("group", number * _groups(bounds) + F.col("group")).repartition(SLICES, "group")


def _grouped_vessels(points: DataFrame, occupied: DataFrame, bounds: list[int], config: Detection, ordered: bool = False) -> DataFrame:
    """A row of arrays for a vessel, or for each ``ROW_BUCKETS`` of its buckets, and for every group the occupied buckets (``side`` 3).

    ``ordered``: several points of a vessel in a bucket are in their order by ``seq``.
    """
    part = F.floor(F.col("bucket") / (max(config.meeting_bucket_s, 1) * ROW_BUCKETS)).alias("part")
    listed = F.collect_list(F.struct("bucket", *(["seq"] if ordered else []), "latitude", "longitude"))
    rows = _usable(points).groupBy("mmsi", part).agg((F.sort_array(listed) if ordered else listed).alias("p"))
    rows = _dealt(rows.select("mmsi", "p.bucket", "p.latitude", "p.longitude"), bounds)
    given = occupied.where("bucket is not null").groupBy(part).agg(F.collect_list(F.struct("bucket", F.coalesce("before", F.lit(NEVER)).alias("before"))).alias("p"))
    none = F.array().cast("array<double>")
    given = given.select(F.explode(F.sequence(F.lit(0), F.lit(_groups(bounds) - 1))).alias("group"), F.lit(3).alias("side"), F.lit(0).cast("long").alias("mmsi"), "p.bucket", none.alias("latitude"), none.alias("longitude"), "p.before")
    return _by_group(rows.withColumn("before", F.array().cast("array<long>")).unionByName(given), bounds)


def _spans(a: dict, b: dict, size: float, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(order of b, first, end): for each point of ``a`` places in that order which hold all of ``b`` that can be close, in several lists."""
    band = lambda p, d=0: (np.floor(p["latitude"] / size) + d).astype(np.int64)
    if exact:  # longitudes in cells as wide as at the equator; a band's reach in them grows with latitude
        turn = math.ceil(360 / size)
        x = lambda p: np.floor((p["longitude"] + 180) % 360.0 / size).astype(np.int64)
        farthest = np.minimum(90.0, (np.abs(a["latitude"]) + 2 * size))
        reach = np.minimum(np.ceil(1 / np.maximum(np.cos(np.radians(farthest)), 1e-9)) + 1, turn).astype(np.int64)
        whole = 2 * reach + 2 >= turn
        low, high = np.where(whole, 0, x(a) - reach), np.where(whole, turn, x(a) + reach)
        shifts = (0, -turn, turn)
    else:
        x = lambda p: np.floor(p["longitude"] / size).astype(np.int64)
        low, high, whole, shifts = x(a) - 1, x(a) + 1, np.zeros(len(a["mmsi"]), bool), (0,)
    wide = 1 << 33  # more than all cells of a band
    bands = np.unique(np.stack([b["bucket"], band(b)], axis=1), axis=0) if len(b["mmsi"]) else np.zeros((0, 2), np.int64)
    packed = bands[:, 0] * (1 << 24) + bands[:, 1]  # sorted as the rows are
    place = lambda bucket, y: np.searchsorted(packed, bucket * (1 << 24) + y)
    key = place(b["bucket"], band(b)) * wide + x(b) + wide // 2
    order = np.argsort(key, kind="stable")
    key = key[order]
    for d in (-1, 0, 1):
        at = place(a["bucket"], band(a, d))
        there = (at < len(packed)) & (packed[np.minimum(at, max(len(packed) - 1, 0))] == a["bucket"] * (1 << 24) + band(a, d)) if len(packed) else np.zeros(len(at), bool)
        for shift in shifts:
            first = np.searchsorted(key, at * wide + low + shift + wide // 2, "left")
            end = np.searchsorted(key, at * wide + high + shift + wide // 2, "right")
            yield order, first, np.where(there & ~(whole & (shift != 0)), np.maximum(end, first), first)


def _candidates(a: dict, b: dict, size: float, exact: bool, at_a_time: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``a`` and ``b`` of points that can be close, the smaller vessel in ``a``; whole vessels of ``a`` at a time. ``a`` is ordered by vessel."""
    if not len(a["mmsi"]) or not len(b["mmsi"]):
        return
    spans = list(_spans(a, b, size, exact))
    work = np.cumsum(sum(end - first for _, first, end in spans))
    new = np.flatnonzero(np.r_[True, a["mmsi"][1:] != a["mmsi"][:-1]])  # a vessel's first point
    share = np.r_[0, work][new] // at_a_time
    cuts = [*new[np.flatnonzero(np.r_[True, share[1:] != share[:-1]])], len(a["mmsi"])]
    apart = a["mmsi"].max() < b["mmsi"].min()  # different ranges
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        left, right = [], []
        for order, first, end in spans:
            n = (end - first)[low:high]
            rows = np.repeat(np.arange(low, high), n)
            at = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[low:high], n)
            other = order[at]
            if not apart:
                kept = a["mmsi"][rows] < b["mmsi"][other]
                rows, other = rows[kept], other[kept]
            left.append(rows)
            right.append(other)
        yield np.concatenate(left), np.concatenate(right)


def _observations(a: dict, b: dict, km: float, size: float, exact: bool, ordered: bool = True) -> Iterator[tuple[dict, dict, np.ndarray]]:
    """(a, b, km) of each pair's closest points in a bucket, ordered by pair and bucket unless that isn't needed; whole pairs at a time. ``a`` is ordered by vessel."""
    for ia, ib in _candidates(a, b, size, exact, CANDIDATES):
        far = haversine_km_of(a["latitude"][ia], a["longitude"][ia], b["latitude"][ib], b["longitude"][ib])
        near = far <= km
        if not near.all():
            ia, ib, far = ia[near], ib[near], far[near]
        if ordered or a["several"] or b["several"]:
            order = np.lexsort((b["tie"][ib], a["tie"][ia], far, a["bucket"][ia], b["mmsi"][ib], a["mmsi"][ia])) if a["several"] or b["several"] else np.lexsort((a["bucket"][ia], b["mmsi"][ib], a["mmsi"][ia]))
            ia, ib, far = ia[order], ib[order], far[order]
        if len(ia) and (a["several"] or b["several"]):
            same = (a["mmsi"][ia][1:] == a["mmsi"][ia][:-1]) & (b["mmsi"][ib][1:] == b["mmsi"][ib][:-1]) & (a["bucket"][ia][1:] == a["bucket"][ia][:-1])
            best = np.r_[True, ~same]
            ia, ib, far = ia[best], ib[best], far[best]
        if len(ia):
            yield {c: a[c][ia] for c in ("mmsi", "bucket", "before", "latitude", "longitude") if c in a}, {c: b[c][ib] for c in ("mmsi", "latitude", "longitude")}, far


def _is_near(a: dict, b: dict, km: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A test of places in ``a`` and ``b``: by chords, and by the distance itself where a chord is too near to the limit to tell."""
    ends = []
    for side in (a, b):
        lat, lon = np.radians(side["latitude"]), np.radians(side["longitude"])
        ends.append((np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)))
    limit = (2 * math.sin(min(km / (2 * EARTH_RADIUS_KM), math.pi / 2))) ** 2
    slack = 1e-6 * limit + 1e-13 * math.sqrt(limit) + 1e-26  # far above the errors of the sums

    def near(ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
        square = np.zeros(len(ia))
        for p, q in zip(*ends, strict=True):
            d = p[ia] - q[ib]
            square += d * d
        found = square <= limit
        unsure = np.flatnonzero(np.abs(square - limit) <= slack)
        if len(unsure):
            i, j = ia[unsure], ib[unsure]
            found[unsure] = haversine_km_of(a["latitude"][i], a["longitude"][i], b["latitude"][j], b["longitude"][j]) <= km
        return found

    return near


def _counts_by_keys(a: dict, b: dict, config: Detection, size: float, exact: bool, strict_gap: bool, least_h: float, ends: Ends = None) -> tuple[np.ndarray, np.ndarray]:
    """As ``_counts``, whatever the limits. An observation is one number: first vessel, second vessel, bucket."""
    near = _is_near(a, b, config.meeting_km)
    vessels_a, of_a = np.unique(a["mmsi"], return_inverse=True)
    vessels_b, of_b = np.unique(b["mmsi"], return_inverse=True)
    buckets, at = np.unique(a["bucket"], return_inverse=True)  # a pair's are among them
    reference = buckets.copy()
    if not strict_gap:
        reference[at] = a["before"]
    back = np.arange(len(buckets)) - np.searchsorted(buckets, reference - config.continuation_s)
    bits_b, bits_t = len(vessels_b).bit_length(), len(buckets).bit_length()
    if len(vessels_a).bit_length() + bits_b + bits_t > 63:
        raise ValueError("a group of crowds has too many vessels and buckets")
    key_a, key_b = (of_a.astype(np.int64) << (bits_b + bits_t)) + at, of_b.astype(np.int64) << bits_t
    met_a, met_b = np.zeros(len(vessels_a), np.int64), np.zeros(len(vessels_b), np.int64)
    for ia, ib in _candidates(a, b, size, exact, COUNTED_AT_A_TIME):
        found = near(ia, ib)
        if not found.all():
            ia, ib = ia[found], ib[found]
        key = key_a[ia] + key_b[ib]
        if not len(key):
            continue
        key.sort()
        if a["several"] or b["several"]:
            key = key[np.r_[True, key[1:] != key[:-1]]]
        t = key & ((1 << bits_t) - 1)
        # a session goes on from an observation of the pair at most so many buckets before
        first = np.flatnonzero(np.r_[True, key[:-1] < key[1:] - back[t[1:]]])
        last = np.r_[first[1:], len(key)] - 1
        long = (buckets[t[last]] - buckets[t[first]]) / 3600.0 >= least_h
        met = key[first[long if ends is None else long & _within(buckets[t[last]], ends)]] >> bits_t
        met_a += np.bincount(met >> bits_b, minlength=len(vessels_a))
        met_b += np.bincount(met & ((1 << bits_b) - 1), minlength=len(vessels_b))
    vessels, met = np.r_[vessels_a, vessels_b], np.r_[met_a, met_b]
    return vessels[met > 0], met[met > 0]


def _within(buckets: np.ndarray, ends: tuple[int | None, int | None]) -> np.ndarray:
    low, high = ends
    return (buckets >= (NEVER if low is None else low)) & (buckets < (-NEVER if high is None else high))


def _windows(buckets: np.ndarray, back: np.ndarray, need: np.ndarray, by_end: bool = False) -> list[tuple[int, int, int, int]] | None:
    """(first, end, first beginning, end of beginnings): windows of at most ``BITS`` buckets, in each of which sessions that begin at its beginnings can be judged; None if they hold too few.

    What goes on from a bucket lies within the largest ``back``; a session from t is long enough if it doesn't end before ``need``. ``by_end``: the same of ends,
    where a session up to t is long enough if it begins at ``need`` at the latest, -1 if none is.
    """
    total = len(buckets)
    if total <= BITS:
        return [(0, total, 0, total)]
    reach, long = int(back.max()), int(np.where((need >= 0) & (need < total), np.abs(need - np.arange(total)), 0).max())
    if (stride := BITS - 2 * reach - long) < LEAST_STARTS:
        return None
    earlier = reach + long if by_end else reach
    return [(max(0, t - earlier), min(total, t - earlier + BITS), t, min(total, t + stride)) for t in range(0, total, stride)]


def _long_sessions(met: np.ndarray, back: np.ndarray, span: np.ndarray, starts: np.ndarray, by_end: bool = False) -> np.ndarray:
    """How many sessions of each pair begin at ``starts`` (booleans; ``by_end``: end there) and last ``span`` buckets; ``met``: a bit for each bucket in which the pair was observed."""
    n = len(back)
    bits = lambda wanted: np.uint64(sum(1 << int(t) for t in np.flatnonzero(wanted)))
    before, after, part = np.zeros_like(met), np.zeros_like(met), np.empty_like(met)
    for d in range(1, int(back.max(initial=0)) + 1):
        go_on = (back >= d) | (np.arange(n) < d)  # the bits that a shift by d loses need no care
        seen = met if go_on.all() else met & bits(go_on)
        before |= np.left_shift(met, np.uint64(d), out=part) if go_on.all() else np.left_shift(met, np.uint64(d), out=part) & bits(go_on)
        after |= np.right_shift(seen, np.uint64(d), out=part)
    begins, ends = met & ~before, met & ~after
    if by_end:
        ends &= bits(starts)
        for d in range(int(span[starts].max(initial=0))):  # a beginning too late
            longer = (span > d) | ~starts
            late = np.left_shift(begins, np.uint64(d), out=part)
            ends &= ~late if longer.all() else ~(late & bits(longer))
        return np.bitwise_count(ends)
    begins &= bits(starts)
    for d in range(int(span[starts].max(initial=0))):  # an end too early
        longer = (span > d) | ~starts
        early = np.right_shift(ends, np.uint64(d), out=part)
        begins &= ~early if longer.all() else ~(early & bits(longer))
    return np.bitwise_count(begins)


class _Places:
    """The points of a side by places: parts of cells, each with a ball around its points. Balls tell of two places whether all, none or some of their points are close."""

    def __init__(self, side: dict, size: float, exact: bool):
        lat, lon = side["latitude"], side["longitude"]
        y, x = (np.floor(v / size) for v in (lat, (lon + 180) % 360.0 if exact else lon))
        cut = lambda v, cell: np.clip(((v / size - cell) * CUTS).astype(np.int64), 0, CUTS - 1)
        keys = [cut((lon + 180) % 360.0 if exact else lon, x), x, cut(lat, y), y]
        order = np.lexsort(keys)
        new = np.r_[True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)]
        self.of = np.empty(len(lat), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.n = int(new.sum())
        first = order[np.flatnonzero(new)]
        self.as_points = {"latitude": lat[first], "longitude": lon[first], "bucket": np.zeros(self.n, np.int64)}
        sphere = np.stack([np.cos(np.radians(lat)) * np.cos(np.radians(lon)), np.cos(np.radians(lat)) * np.sin(np.radians(lon)), np.sin(np.radians(lat))])
        self.centre = np.stack([np.bincount(self.of, v, self.n) for v in sphere]) / np.bincount(self.of, minlength=self.n)
        self.radius = np.zeros(self.n)
        np.maximum.at(self.radius, self.of, np.sqrt(((sphere - self.centre[:, self.of]) ** 2).sum(axis=0)))


def _near_places(a: _Places, b: _Places, km: float, size: float, exact: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each place of ``a`` those of ``b``: all of whose points are close to all of its own, and some of whose points may be."""
    chord = 2 * math.sin(min(km / (2 * EARTH_RADIUS_KM), math.pi / 2))
    sure, unsure = [], []
    numbered = lambda p, at: p.as_points | {"mmsi": np.arange(p.n) + at}
    for i, j in _candidates(numbered(a, 0), numbered(b, a.n), size, exact, CANDIDATES):
        apart, slack = np.sqrt(((a.centre[:, i] - b.centre[:, j]) ** 2).sum(axis=0)), a.radius[i] + b.radius[j]
        all_near = apart + slack <= chord * (1 - 1e-6) - 1e-13
        may_be = ~all_near & (apart - slack <= chord * (1 + 1e-6) + 1e-13)
        sure.append(np.stack([i[all_near], j[all_near]]))
        unsure.append(np.stack([i[may_be], j[may_be]]))
    told = []
    for pairs in (sure, unsure):
        i, j = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        order = np.lexsort((j, i))
        told.append(np.split(j[order], np.searchsorted(i[order], np.arange(1, a.n))))
    return told[0], told[1]


def _counting(n: np.ndarray) -> np.ndarray:
    """From 0 up to each of the numbers, one after another."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _joined(*keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, each with all its bits."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    first = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if len(order) else order
    return *(k[first] for k in keys), np.bitwise_or.reduceat(bits[order], first) if len(first) else bits


class _Window:
    """A window's observations of two sides: bits of vessels by class of places (``a``) or by place (``b``), and the points of places that aren't wholly close."""

    def __init__(self, a: dict, b: dict, t_a: np.ndarray, t_b: np.ndarray, at: _Places, other: _Places, classes: np.ndarray, near: list[np.ndarray], unsure: list[np.ndarray], is_near: Callable):
        self.near, self.is_near, self.place_a, self.t_a = near, is_near, at.of, t_a
        self.unsure, self.unsure_first = np.concatenate([*unsure, np.zeros(0, np.int64)]), np.cumsum([0, *map(len, unsure)])
        one = np.uint64(1)
        inside = np.flatnonzero((t_a >= 0) & (classes[at.of] >= 0))
        self.vessel, self.kind, self.bits = _joined(a["no"][inside], classes[at.of[inside]], bits=one << t_a[inside].astype(np.uint64))
        inside = np.flatnonzero(t_b >= 0)
        self.b_place, self.b_vessel, self.b_bits = _joined(other.of[inside], b["no"][inside], bits=one << t_b[inside].astype(np.uint64))
        self.b_first = np.searchsorted(self.b_place, np.arange(other.n + 1))
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        # points of a that need a look at single points of b, by vessel; those of b by place and bucket
        self.edge = np.flatnonzero((t_a >= 0) & (np.diff(self.unsure_first) > 0)[at.of])
        self.edge = self.edge[np.argsort(a["no"][self.edge], kind="stable")]
        self.edge_no, self.b_no = a["no"][self.edge], b["no"]
        key = other.of[inside] * BITS + t_b[inside]
        self.b_points = inside[np.argsort(key, kind="stable")]
        self.b_key = np.sort(key)

    def others(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Vessels of ``b`` wholly close to a class, with their bits."""
        if kind not in self.known:
            if sum(len(v) for v, _ in self.known.values()) > CANDIDATES:
                self.known.clear()
            first, n = self.b_first[self.near[kind]], np.diff(self.b_first)[self.near[kind]]
            at = np.repeat(first, n) + _counting(n)
            self.known[kind] = _joined(self.b_vessel[at], bits=self.b_bits[at])
        return self.known[kind]

    def single(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Vessels of ``b`` with points close to single points of a vessel, its edges from ``low`` to ``high``, and the bits of these."""
        if low == high:
            return self.b_no[:0], self.bits[:0]
        edge = self.edge[low:high]
        n = self.unsure_first[self.place_a[edge] + 1] - self.unsure_first[self.place_a[edge]]
        point = np.repeat(edge, n)
        key = self.unsure[np.repeat(self.unsure_first[self.place_a[edge]], n) + _counting(n)] * BITS + self.t_a[point]
        first, end = np.searchsorted(self.b_key, key, "left"), np.searchsorted(self.b_key, key, "right")
        n = end - first
        point, at = np.repeat(point, n), self.b_points[np.repeat(first, n) + _counting(n)]
        near = self.is_near(point, at)
        return _joined(self.b_no[at[near]], bits=np.uint64(1) << self.t_a[point[near]].astype(np.uint64))

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(vessels of a, vessels of b, the bits of each pair), some vessels of ``a`` at a time, those of one main class together."""
        vessels = np.unique(np.r_[self.vessel, self.edge_no])
        first = np.searchsorted(self.vessel, vessels)
        end = np.searchsorted(self.vessel, vessels, "right")
        edge_first, edge_end = np.searchsorted(self.edge_no, vessels), np.searchsorted(self.edge_no, vessels, "right")
        by_bits = np.lexsort((-np.bitwise_count(self.bits).astype(np.int64), self.vessel))
        main = np.where(end > first, self.kind[by_bits[np.minimum(first, len(by_bits) - 1)]] if len(by_bits) else -1, -1)
        taken, kinds, wide, singles = [], set(), 0, []
        for v in np.argsort(main, kind="stable"):
            mine = {int(k) for k in self.kind[first[v] : end[v]]} - kinds
            single = self.single(edge_first[v], edge_end[v])
            more = sum(len(self.others(k)[0]) for k in mine) + len(single[0])
            if taken and (len(taken) + 1) * (wide + more) > COUNTED_AT_A_TIME:
                yield self._block(vessels[taken], first[taken], end[taken], kinds, singles)
                taken, kinds, singles = [], set(), []
                mine = {int(k) for k in self.kind[first[v] : end[v]]}
                wide, more = 0, sum(len(self.others(k)[0]) for k in mine) + len(single[0])
            singles += [(len(taken), *single)] if len(single[0]) else []
            taken.append(v)
            kinds |= mine
            wide += more
        if taken:
            yield self._block(vessels[taken], first[taken], end[taken], kinds, singles)

    def _block(self, vessels: np.ndarray, first: np.ndarray, end: np.ndarray, kinds: set[int], singles: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = np.unique(np.concatenate([np.zeros(0, np.int64), *(self.others(k)[0] for k in kinds), *(s[1] for s in singles)]))
        met = np.zeros((len(vessels), len(cols)), np.uint64)
        entry = np.repeat(first, end - first) + _counting(end - first)
        row_of = np.repeat(np.arange(len(vessels)), end - first)
        order = np.argsort(self.kind[entry], kind="stable")
        entry, row_of = entry[order], row_of[order]
        for kind in kinds:
            low, high = np.searchsorted(self.kind[entry], kind), np.searchsorted(self.kind[entry], kind, "right")
            rows, bits = row_of[low:high], self.bits[entry[low:high]]
            others, their = self.others(kind)
            at = np.searchsorted(cols, others)
            if 4 * len(rows) * len(at) < met.size:
                met[np.ix_(rows, at)] |= bits[:, None] & their[None, :]
                continue
            whole, whole_b = np.zeros(len(vessels), np.uint64), np.zeros(len(cols), np.uint64)
            whole[rows], whole_b[at] = bits, their
            met |= whole[:, None] & whole_b[None, :]
        for row, others, bits in singles:
            met[row, np.searchsorted(cols, others)] |= bits
        return vessels, cols, met


def _limits(common: np.ndarray, buckets: np.ndarray, before: np.ndarray, config: Detection, strict_gap: bool, least_h: float) -> tuple[np.ndarray, np.ndarray]:
    """(back, need) of the buckets ``common``: a session goes on to one from at most so many before it, and from one lasts long enough if it doesn't end before that place."""
    reference = common if strict_gap else before[np.searchsorted(buckets, common)]
    back = np.arange(len(common)) - np.searchsorted(common, reference - config.continuation_s)
    back[0] = 0
    return back, np.searchsorted(common, common + _least_s(least_h))


def _least_s(least_h: float) -> int:
    """The least whole seconds that last so many hours."""
    least = max(0, math.floor(least_h * 3600) - 2)
    while least / 3600.0 < least_h:
        least += 1
    return least


def _at(side: dict, common: np.ndarray) -> np.ndarray:
    """The place of each point's bucket in ``common``, or -1."""
    return np.where(np.isin(side["bucket"], common), np.searchsorted(common, side["bucket"]), -1)


def _in_order(side: dict, buckets: np.ndarray, before: np.ndarray) -> None:
    """A side's points by vessel and bucket, those of one bucket as they come, with the occupied bucket before their own: as ``_observations`` takes them."""
    side["before"] = before[np.searchsorted(buckets, side["bucket"])]
    order = np.lexsort((side["bucket"], side["mmsi"]))
    side |= {c: side[c][order] for c in ("mmsi", "bucket", "latitude", "longitude", "before")}
    side["tie"] = np.arange(len(order))
    side["several"] = bool(((side["mmsi"][1:] == side["mmsi"][:-1]) & (side["bucket"][1:] == side["bucket"][:-1])).any())


def _windows_of(a: dict, b: dict, config: Detection, size: float, exact: bool) -> Callable[[np.ndarray, np.ndarray], _Window]:
    """What makes a window of the places of points in it, or -1. Places of ``a`` to which the same places of ``b`` are wholly close are a class."""
    places, others = _Places(a, size, exact), None if a is b else _Places(b, size, exact)
    others = others or places
    sure, unsure = _near_places(places, others, config.meeting_km, size, exact)
    numbers: dict[bytes, int] = {}
    classes = np.array([numbers.setdefault(q.tobytes(), len(numbers)) if len(q) else -1 for q in sure], np.int64)
    near = [np.frombuffer(q, np.int64) for q in numbers]
    is_near = _is_near(a, b, config.meeting_km)
    return lambda t_a, t_b: _Window(a, b, t_a, t_b, places, others, classes, near, unsure, is_near)


def _session_observations(a: dict, b: dict, buckets: np.ndarray, before: np.ndarray, config: Detection, size: float, exact: bool, strict_gap: bool, least_h: float, open_after: int | None) -> Iterator[tuple[dict, dict, np.ndarray]]:
    """As ``_observations``, at least those of pairs with sessions that last ``least_h`` or end after ``open_after``.

    When a pair met are bits, as in ``_counts``: only pairs that are wanted have observations, in order as they come. More buckets than bits, or several points of a vessel
    in a bucket: by single points.
    """
    common = np.intersect1d(a["bucket"], b["bucket"])
    if not len(common):
        return
    at_a, at_b = _at(a, common), _at(b, common)
    point_a, point_b = (np.full((len(side["vessels"]), min(len(common), BITS)), -1, np.int32) for side in (a, b))
    by_bits = len(common) <= BITS
    for side, at, point in ((a, at_a, point_a), (b, at_b, point_b)) if by_bits else ():
        inside = np.flatnonzero(at >= 0)
        point[side["no"][inside], at[inside]] = inside
        by_bits &= np.count_nonzero(point >= 0) == len(inside)
    if not by_bits:
        for side in (a, b):
            _in_order(side, buckets, before)
        yield from _observations(a, b, config.meeting_km, size, exact)
        return
    back, need = _limits(common, buckets, before, config, strict_gap, least_h)
    t = np.arange(len(common))
    back, going = np.minimum(np.maximum(back, 0), t), np.zeros(len(common), bool) if open_after is None else common > open_after
    going = np.uint64(sum(1 << int(k) for k in np.flatnonzero(going)))
    reference = before[np.searchsorted(buckets, common)]
    for rows, cols, met in _windows_of(a, b, config, size, exact)(at_a, at_b).blocks():
        wanted = met != 0 if least_h <= 0 else _long_sessions(met, back, need - t, need < len(common)) > 0
        if going:
            wanted |= (met & going) != 0
        if a is b:  # each pair is met from either side
            wanted &= rows[:, None] < cols[None, :]
        i, j = np.nonzero(wanted)
        bits = met[i, j].astype("<u8")
        for k in range(0, len(i), _PAIRS_OUT):
            flags = np.unpackbits(bits[k : k + _PAIRS_OUT].view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
            pair, at = np.nonzero(flags)
            ia, ib = point_a[rows[i[k + pair]], at], point_b[cols[j[k + pair]], at]
            far = haversine_km_of(a["latitude"][ia], a["longitude"][ia], b["latitude"][ib], b["longitude"][ib])
            told = {"mmsi": a["mmsi"][ia], "bucket": common[at], "before": reference[at], "latitude": a["latitude"][ia], "longitude": a["longitude"][ia]}
            yield told, {c: b[c][ib] for c in ("mmsi", "latitude", "longitude")}, far


def _counts(a: dict, b: dict, buckets: np.ndarray, before: np.ndarray, config: Detection, size: float, exact: bool, strict_gap: bool, least_h: float, ends: Ends = None) -> tuple[np.ndarray, np.ndarray]:
    """(vessel, sessions) of those with any that last long enough; a vessel may come twice. ``buckets``, ``before``: the occupied ones, in order. ``ends``: only sessions that end from the first on and before the second.

    A side has ``no`` beside its points, the place of their vessel among its ``vessels``. For a vessel the buckets in a class of places (``_windows_of``) are bits, as are for another the buckets in places close to it; what both have is when they met.
    """
    common = np.intersect1d(a["bucket"], b["bucket"])
    nothing = np.zeros(0, np.int64)
    if not len(common):
        return nothing, nothing
    back, need = _limits(common, buckets, before, config, strict_gap, least_h)
    wanted = need < len(common)
    if ends is not None:  # the last place to begin at, instead of the first to end at
        need = np.searchsorted(common, common - _least_s(least_h), "right") - 1
        wanted = (need >= 0) & _within(common, ends)
    windows = _windows(common, np.maximum(back, 0), need, ends is not None)
    if windows is None:
        for side in (a, b):
            _in_order(side, buckets, before)
        return _counts_by_keys(a, b, config, size, exact, strict_gap, least_h, ends)
    same = a is b  # each pair is met from either side, and told for one
    met_a, met_b = np.zeros(len(a["vessels"]), np.int64), np.zeros(len(b["vessels"]), np.int64)
    at_a, at_b = _at(a, common), _at(b, common)
    window = _windows_of(a, b, config, size, exact)
    for first, end, start, last in windows:
        t_a, t_b = (np.where((t >= first) & (t < end), t - first, -1) for t in (at_a, at_b))
        here, t = np.arange(first, end), np.arange(end - first)
        starts = (here >= start) & (here < last) & wanted[first:end]
        if not starts.any():
            continue
        reach = np.minimum(np.maximum(back[first:end], 0), t)
        for rows, cols, met in window(t_a, t_b).blocks():
            if not len(cols):
                continue
            if same:
                at = np.minimum(np.searchsorted(cols, rows), len(cols) - 1)
                mine = np.flatnonzero(cols[at] == rows)
                met[mine, at[mine]] = 0
            n = _long_sessions(met, reach, np.abs(need[first:end] - here), starts, ends is not None)
            met_a[rows] += n.sum(axis=1, dtype=np.int64)
            if not same:
                met_b[cols] += n.sum(axis=0, dtype=np.int64)
    vessels, met = np.r_[a["vessels"], b["vessels"]], np.r_[met_a, met_b]
    return vessels[met > 0], met[met > 0]


def _vessel_sides(table: pa.Table) -> tuple[dict, dict, np.ndarray, np.ndarray]:
    """The sides of a group as ``_counts`` takes them, one and the same if the group is of one range; the occupied buckets and those before them."""
    column = lambda c: table.column(c).combine_chunks()
    side, sizes = column("side").to_numpy(), pc.list_value_length(column("bucket")).to_numpy(zero_copy_only=False)
    of_point = np.repeat(side, sizes)
    flat = {c: column(c).flatten().to_numpy() for c in ("bucket", "latitude", "longitude", "before")}
    order = np.argsort(flat["bucket"][of_point == 3])
    buckets, before = flat["bucket"][of_point == 3][order], flat["before"][order]
    columns = {"mmsi": np.repeat(column("mmsi").to_numpy(), sizes)[of_point != 3], "bucket": flat["bucket"][of_point != 3], "latitude": flat["latitude"], "longitude": flat["longitude"]}
    of_point = of_point[of_point != 3]
    sides = []
    for mine in ((2,), ()) if (of_point == 2).any() else ((0,), (1,)):
        if mine:
            found = {c: v[np.isin(of_point, mine)] for c, v in columns.items()}
            found["vessels"], found["no"] = np.unique(found["mmsi"], return_inverse=True)
        sides.append(found)
    return sides[0], sides[1], buckets, before


def _sides(batches: Iterator[pa.RecordBatch]) -> tuple[dict, dict]:
    table = pa.Table.from_batches(list(batches))
    columns = {c: table.column(c).to_numpy() for c in ("mmsi", "bucket", "latitude", "longitude", "tie", "side")}
    order = np.lexsort((columns["bucket"], columns["mmsi"]))
    columns = {c: v[order] for c, v in columns.items()}
    sides = []
    for other in (1, 0):
        mine = columns["side"] != other
        side = {c: v[mine] for c, v in columns.items()}
        side["several"] = bool((side["tie"] > 1).any())
        sides.append(side)
    return sides[0], sides[1]


def _told(names: list[str], values: list) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(values[0]), _ROWS_OUT):
        yield pa.RecordBatch.from_arrays([v[k : k + _ROWS_OUT] if isinstance(v, pa.Array) else pa.array(v[k : k + _ROWS_OUT]) for v in values], names=names)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _ROWS_OUT:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def crowded_pairs(points: DataFrame, bounds: list[int], config: Detection, exact_grid: bool = False) -> DataFrame:
    """As ``meetings.pair_observations``. Each slice of buckets has its own groups, so ranges are few: one, as long as a slice's points aren't too many."""
    names, km, size = [c.split()[0] for c in PAIRS.split(", ")], config.meeting_km, grid_degrees(config.meeting_km)
    ship_package(points.sparkSession)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, far in _observations(*_sides(batches), km, size, exact_grid, ordered=False):
            yield from _told(names, [a["mmsi"], b["mmsi"], a["bucket"], a["latitude"], a["longitude"], b["latitude"], b["longitude"], far])

    return _grouped(points, bounds).groupBy("group").applyInArrow(tell, PAIRS)


def crowded_sessions(points: DataFrame, bounds: list[int], config: Detection, exact_grid: bool = False, strict_gap: bool = False, least_h: float = 0.0, open_after: int | None = None, occupied: DataFrame | None = None) -> DataFrame:
    """As ``meetings.sessions_of``; ``occupied`` as for ``joined_pieces``, else ``points`` have the last occupied bucket before their own (``before``)."""
    names, gap, size = [c.split()[0] for c in SESSIONS.split(", ")], config.continuation_s, grid_degrees(config.meeting_km)
    occupied = points.groupBy("bucket").agg(F.max("before").alias("before")) if occupied is None else occupied
    ship_package(points.sparkSession)

    def tell(a: dict, b: dict, km: np.ndarray, since: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        bucket = a["bucket"]
        reference = bucket if strict_gap else a["before"]
        apart = (a["mmsi"][1:] != a["mmsi"][:-1]) | (b["mmsi"][1:] != b["mmsi"][:-1]) | (reference[1:] - bucket[:-1] > gap)
        first = np.flatnonzero(np.r_[True, apart])
        last = np.r_[first[1:], len(bucket)] - 1
        n, hours = last - first + 1, (bucket[last] - bucket[first]) / 3600.0
        least, mean = np.minimum.reduceat(km, first), np.add.reduceat(km, first) / n
        kept = hours >= least_h
        if open_after is not None:
            going = first[bucket[last] > open_after]
            kept &= bucket[last] <= open_after
            for side, (vessels, earliest) in zip((a, b), since, strict=True):
                np.minimum.at(earliest, np.searchsorted(vessels, side["mmsi"][going]), bucket[going])
        f, e = first[kept], last[kept]
        places = [side[c][at] for at in (f, e) for side in (a, b) for c in ("latitude", "longitude")]
        yield from _told(names, [a["mmsi"][f], b["mmsi"][f], bucket[f], bucket[e], hours[kept], n[kept], least[kept], mean[kept], *places])

    def found(a: dict, b: dict, buckets: np.ndarray, before: np.ndarray) -> Iterator[pa.RecordBatch]:
        since = [(side["vessels"], np.full(len(side["vessels"]), np.iinfo(np.int64).max)) for side in (a, b)]
        for seen in _session_observations(a, b, buckets, before, config, size, exact_grid, strict_gap, least_h, open_after):
            if len(seen[2]):
                yield from tell(*seen, since)
        for vessels, earliest in since:
            is_open = earliest < np.iinfo(np.int64).max
            nothing = [pa.nulls(int(is_open.sum()), pa.int64() if c in ("mmsi_b", "end_epoch", "observations") else pa.float64()) for c in names]
            yield from _told(names, [vessels[is_open] if c == "mmsi_a" else earliest[is_open] if c == "start_epoch" else none for c, none in zip(names, nothing, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(found(*_vessel_sides(pa.Table.from_batches(list(batches)))))

    return _grouped_vessels(points, occupied, bounds, config, ordered=True).groupBy("group").applyInArrow(run, SESSIONS)


def crowded_counts(points: DataFrame, occupied: DataFrame, bounds: list[int], config: Detection, exact_grid: bool = False, strict_gap: bool = False, least_h: float = 0.0, ends: Ends = None) -> DataFrame:
    """As ``meetings.session_counts``; ``occupied`` as for ``joined_pieces``. Groups tell a row for each vessel with sessions, at most two for a group of one range."""
    size = grid_degrees(config.meeting_km)
    ship_package(points.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, buckets, before = _vessel_sides(pa.Table.from_batches(list(batches)))
        yield from _told(["mmsi", "n"], list(_counts(a, b, buckets, before, config, size, exact_grid, strict_gap, least_h, ends)))

    return _grouped_vessels(points, occupied, bounds, config).groupBy("group").applyInArrow(run, COUNTS).groupBy("mmsi").agg(F.sum("n").alias("n"))
