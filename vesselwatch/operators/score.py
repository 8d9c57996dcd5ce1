"""Per-vessel summary, suspicion score and rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vesselwatch.config import Detection
from vesselwatch.functions.geo import nautical_miles
from vesselwatch.operators.meetings import counted
from vesselwatch.operators.tracks import POINT, in_track
from vesselwatch.session import discard, stored

#: Fixed values of the score: points for each unit.
GAP_HOURS_PER_POINT, MILES_PER_POINT, DRAUGHT_POINTS, EPISODE_POINTS = 2.0, 10.0, 15.0, 20.0


def with_episode_starts(detected: DataFrame, config: Detection) -> DataFrame:
    """``starts_episode``: a D1 jump that begins more than the episode gap after all earlier ones ended.

    On sliced tracks this looks at the jumps of the same slice only; ``merged`` then holds the first ones against earlier slices.
    """
    d1 = F.col("subtype") == "D1"
    w = in_track(*(["part"] if "part" in detected.columns else []))
    ended = F.max(F.when(d1, F.col("ts"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.unix_seconds(F.col("prev.ts")) > F.unix_seconds(ended) + _gap(config)
    return detected.withColumn("starts_episode", F.coalesce(d1 & (ended.isNull() | apart), F.lit(False)))


def _gap(config: Detection) -> Column:
    return F.lit(int(config.clone_episode_h * 3600))


#: Columns that add up over parts of a vessel's track; ``max_gap_hours`` is the largest one's.
SUMS = ["record_count", "impossible_jump_km", "silence_events", "draught_events", "jump_events", "d1_events", "d1_episodes", "d2_events", "d2_valid_events", "d2_flagged_events"]


def _partial(starts: DataFrame, config: Detection, group: list[str], *more: Column) -> DataFrame:
    d2 = F.col("subtype") == "D2"
    return starts.groupBy("mmsi", *group).agg(
        F.count("*").alias("record_count"),
        F.coalesce(F.max(F.when(F.col("is_silence"), F.col("sample_hours"))), F.lit(0.0)).alias("max_gap_hours"),
        F.coalesce(F.sum(F.when(d2 & F.col("counts"), F.col("prev_km"))), F.lit(0.0)).alias("impossible_jump_km"),
        F.count_if("is_silence").alias("silence_events"),
        F.count_if("is_draught_change").alias("draught_events"),
        F.count_if(F.col("subtype").isNotNull()).alias("jump_events"),
        F.count_if(F.col("subtype") == "D1").alias("d1_events"),
        F.count_if("starts_episode").alias("d1_episodes"),
        F.count_if(d2).alias("d2_events"),
        F.count_if(d2 & F.col("counts")).alias("d2_valid_events"),
        F.count_if(d2 & ~F.col("counts")).alias("d2_flagged_events"),
        *more,
    )


def track_summaries(detected: DataFrame, config: Detection) -> DataFrame:
    """Mergeable summaries, a row for each vessel or slice of its track (``part``): sums, the last record and sample, and of D1 jumps
    the latest end with the beginnings that are an episode's as far as the slice can tell.

    Their grouping is that of the detectors' windows, so nothing is shuffled for it. Beginnings within a slice lie further apart
    than the episode gap. ``detected`` may be ``narrowed``.
    """
    here, order = F.struct(*POINT), F.struct("ts", "seq")
    starts = _with_starts(detected, config)
    if "part" not in detected.columns:
        starts = starts.withColumn("part", F.lit(None).cast("long"))
    found = _partial(
        starts, config, ["part"], F.unix_seconds(F.max(F.when(F.col("subtype") == "D1", F.col("ts")))).alias("d1_end"),
        F.collect_list(F.when(F.col("starts_episode"), F.unix_seconds("prev.ts"))).alias("d1_starts"),
        F.max_by(here, order).alias("last"), F.max_by(F.when(F.col("is_sample"), here), F.when(F.col("is_sample"), order)).alias("last_sample"),
    )
    return found.withColumn("d1_episodes", F.lit(0).cast("long"))


def merged(summaries: DataFrame, config: Detection, earlier: DataFrame | None = None) -> DataFrame:
    """One summary for each vessel, of its slices and of what ``earlier`` runs merged (the result of this function).

    Episodes need the latest end of all jumps before a slice: a running maximum over slices, a few rows for each vessel;
    within slices it has been taken already.
    """
    rows = summaries.withColumn("place", F.coalesce("part", F.lit(0)))
    if earlier is not None:  # before all slices
        rows = rows.unionByName(earlier.withColumns({"part": F.lit(None).cast("long"), "place": F.lit(-(1 << 62)), "d1_starts": F.array().cast("array<long>")}))
    before = F.max("d1_end").over(Window.partitionBy("mmsi").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).withColumn("d1_episodes", F.col("d1_episodes") + F.size(F.filter("d1_starts", lambda s: F.col("before").isNull() | (s > F.col("before") + _gap(config)))))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(f"{c}.ts", "place"))).alias(c)
    return rows.groupBy("mmsi").agg(*(F.sum(c).alias(c) for c in SUMS), F.max("max_gap_hours").alias("max_gap_hours"), F.max("d1_end").alias("d1_end"), latest("last"), latest("last_sample"))


def vessel_summary(detected: DataFrame, meetings: DataFrame | None = None, config: Detection | None = None, counts: DataFrame | None = None) -> DataFrame:
    """One row per vessel with at least one valid record; the detectors' partitioning by vessel (or slice) is reused. ``counts``: see ``with_meetings``."""
    config = config or Detection()
    if "part" in detected.columns:
        summary = merged(track_summaries(detected, config), config).drop("d1_end", "last", "last_sample")
    else:
        summary = _partial(_with_starts(detected, config), config, [])
    return with_meetings(summary, meetings, counts)


def _with_starts(detected: DataFrame, config: Detection) -> DataFrame:
    return detected if "starts_episode" in detected.columns else with_episode_starts(detected, config)


def narrowed(detected: DataFrame, config: Detection, *more: str) -> DataFrame:
    """Of each record what its vessel's summary takes, and the columns ``more``: written once, they need no window again."""
    d2 = (F.col("subtype") == "D2") & F.col("counts")
    own = [F.when(F.col("is_silence"), F.col("sample_hours")).alias("sample_hours"), F.when(d2, F.col("prev_km")).alias("prev_km")]
    sliced = ["part", "seq", *POINT, "is_sample", F.struct("prev.ts").alias("prev")] if "part" in detected.columns else []
    return with_episode_starts(detected, config).select("mmsi", *sliced, "is_silence", "is_draught_change", "subtype", "counts", "starts_episode", *own, *more)


def with_meetings(summary: DataFrame, meetings: DataFrame | None, counts: DataFrame | None = None) -> DataFrame:
    """``meeting_events``: a vessel's meetings. ``counts`` (mmsi, n): their numbers, where no one needs the meetings themselves."""
    if meetings is None and counts is None:
        return summary.withColumn("meeting_events", F.lit(0).cast("long"))
    met = (counted(meetings) if counts is None else counts).select("mmsi", F.col("n").alias("met"))
    return summary.join(met, "mmsi", "left").withColumn("meeting_events", F.coalesce("met", F.lit(0))).drop("met")


def with_score(summary: DataFrame) -> DataFrame:
    """gap hours / 2 + nautical miles / 10 + 15 per draught change + 20 per D1 episode."""
    score = (
        F.col("max_gap_hours") / GAP_HOURS_PER_POINT + nautical_miles(F.col("impossible_jump_km")) / MILES_PER_POINT
        + F.col("draught_events") * DRAUGHT_POINTS + F.col("d1_episodes") * EPISODE_POINTS
    )
    return summary.withColumn("score", score)


def ranked(scored: DataFrame) -> DataFrame:
    """``rank`` from 1 by falling score, ties by vessel.

    The rows are dealt to ranges of the order, sorted and numbered within them, and written once; ranges and places are
    read from that one table (a second plan could draw other ranges). The ranges' sizes, one row each,
    give the offsets, so no task sees all vessels.
    """
    order = [F.desc("score"), F.asc("mmsi")]
    scored = stored(scored, "scored")  # a row per vessel: drawing the ranges must not run the detection once more
    # the number of a row: its partition above bit 33, its place in it below
    placed = stored(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()), "ranked")
    discard(scored)
    part, place = F.shiftright("__row", 33), F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", before.alias("__before")))  # a row for each shuffle partition
    return (
        placed.withColumn("__part", part).join(offsets, "__part")
        .withColumn("rank", (F.col("__before") + place + 1).cast("int")).drop("__part", "__row", "__before")
    )


def top_vessels(scored: DataFrame, n: int) -> DataFrame:
    """The n highest scores with their rank: a top-n report, so only n rows meet in one task."""
    best = scored.orderBy(F.desc("score"), "mmsi").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "mmsi")))
