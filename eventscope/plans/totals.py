"""Totals that later loads add to, so that density and places need no scan of old events.

Each load writes its own totals at the finest grain, by day; a load run again replaces them.
Counts add up and first keys have a minimum, so totals of several loads merge into those of
all events, in any order. Coarser levels are rolled up from finer ones, step by step.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventscope.functions.values import has_valid_coordinates
from eventscope.operators.groups import LOCATION, location_label
from eventscope.operators.timeline import activity

ACTIVITY, PLACES, DAY = "activity", "places", "event_date"
MINUTES_OF_DAY = 1440


def _with_day(rows: DataFrame, time: str) -> DataFrame:
    return rows.withColumn(DAY, F.to_date(time))


def add_load(
    events: DataFrame, path: str, load: str, *, minutes: int = 60, track: str = "track", time: str = "datetime"
) -> None:
    """Write the totals of a load's events: events per track in windows of ``minutes``, and per
    place and day. ``load`` is a name of the caller's, such as the date; no two loads may
    hold the same event. All loads of a folder have the same ``minutes``, a part of a day.
    Events without a time are left out of both, those without valid coordinates of the places."""
    if minutes <= 0 or MINUTES_OF_DAY % minutes:
        raise ValueError("the finest window must be a part of a day")
    dated = events.where(F.col(time).isNotNull())
    fine = activity(dated, minutes, track, time).withColumnRenamed(track, "track")
    # Places by day, so that a range of days has places of its own.
    found = _with_day(dated, time).where(has_valid_coordinates()).groupBy(*LOCATION, DAY).agg(
        F.min("event_key").alias("location_id"), F.count(F.lit(1)).alias("events")
    )
    for name, table in ((ACTIVITY, _with_day(fine, "window_start")), (PLACES, found)):
        (
            table.hint("rebalance", DAY).write.mode("overwrite").partitionBy(DAY)
            .parquet(f"{path}/{name}/load={load}")
        )


def _between(totals: DataFrame, first, last) -> DataFrame:
    if first is not None:
        totals = totals.where(F.col(DAY) >= F.lit(first).cast("date"))
    return totals if last is None else totals.where(F.col(DAY) <= F.lit(last).cast("date"))


def roll_up(fine: DataFrame, widths: Sequence[int], minutes: int) -> DataFrame:
    """Events per track at several widths in minutes, as ``timeline.activity_at``: each width
    from the widest one that fits into it, the first from ``fine``, windows of ``minutes``."""
    levels: dict[int, DataFrame] = {minutes: fine.select("window_start", "track", "events")}
    for width in sorted(set(widths) - {minutes}):
        if width % minutes:
            raise ValueError(f"{width} minutes are not made of windows of {minutes}")
        below = levels[max(w for w in levels if width % w == 0)]
        start = F.floor(F.unix_millis("window_start") / (width * 60_000)) * (width * 60_000)
        levels[width] = below.groupBy(F.timestamp_millis(start).alias("window_start"), "track").agg(
            F.sum("events").alias("events")
        )
    shown = [levels[w].select(F.lit(w).alias("minutes"), "window_start", "track", "events") for w in sorted(set(widths))]
    return reduce(DataFrame.unionByName, shown)


def read_activity(
    spark: SparkSession, path: str, widths: Sequence[int], *, minutes: int = 60, first=None, last=None
) -> DataFrame:
    """Density of all loads at several widths. With ``first`` and ``last`` only the totals of
    these days are read; windows wider than a day then hold what these days add."""
    if any(w % minutes for w in widths):
        raise ValueError(f"widths must be made of windows of {minutes} minutes")
    totals = _between(spark.read.parquet(f"{path}/{ACTIVITY}"), first, last)
    fine = totals.groupBy("window_start", "track").agg(F.sum("events").alias("events"))
    return roll_up(fine, widths, minutes)


def read_places(spark: SparkSession, path: str, *, first=None, last=None) -> DataFrame:
    """Places of all loads, as ``groups.group_locations`` of all their events: ready to be
    projected and clustered."""
    totals = _between(spark.read.parquet(f"{path}/{PLACES}"), first, last)
    return _merged_places(totals, *LOCATION).withColumn("label", location_label())


def _merged_places(totals: DataFrame, *keys: str) -> DataFrame:
    return totals.groupBy(*keys).agg(F.min("location_id").alias("location_id"), F.sum("events").alias("events"))


def compact(spark: SparkSession, path: str, target: str, load: str) -> None:
    """The totals of all loads in ``path`` as one load of the folder ``target``."""
    activity_sum = spark.read.parquet(f"{path}/{ACTIVITY}").groupBy("window_start", "track", DAY).agg(
        F.sum("events").alias("events")
    )
    places_sum = _merged_places(spark.read.parquet(f"{path}/{PLACES}"), *LOCATION, DAY)
    for name, table in ((ACTIVITY, activity_sum), (PLACES, places_sum)):
        table.hint("rebalance", DAY).write.mode("overwrite").partitionBy(DAY).parquet(f"{target}/{name}/load={load}")
