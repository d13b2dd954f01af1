"""Stories: events of a narrative in time order, and what follows from the order."""

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from eventscope import fixed_values as fixed
from eventscope.functions.predicates import matches_filters
from eventscope.functions.values import is_located, to_number
from eventscope.operators.ordering import ROWS_PER_BUCKET, numbered

ORDER = ["datetime", "pos"]


def _cut(rows: DataFrame, order: Sequence[str], rows_per_bucket: int | None) -> dict:
    """A story may be all events there are. Those in time order are numbered day by day, or, if
    ``rows_per_bucket`` is given, by buckets of about so many rows; others by such buckets
    if a whole number comes first in their order."""
    timed = order[0] == "datetime"
    if timed and rows_per_bucket is None:
        return {"bucket": F.to_date("datetime")}
    if not timed and not isinstance(rows.schema[order[0]].dataType, T.IntegralType):
        return {}
    along = F.unix_micros("datetime") if timed else F.col(order[0])
    return {"along": along, "rows_per_bucket": rows_per_bucket or ROWS_PER_BUCKET}


def steps_in_order(
    rows: DataFrame, order: Sequence[str] = ORDER, rows_per_bucket: int | None = None
) -> DataFrame:
    """Rows with a ``narrative_id`` as steps with place, total, and the next step's end of the leg."""
    here = F.struct("event_key", "latitude", "longitude")
    return numbered(
        rows, ["narrative_id"], order,
        index="step_idx", total="steps", following={"next": here}, **_cut(rows, order, rows_per_bucket),
    ).withColumns({
        "has_previous": F.col("step_idx") > 0,
        "has_next": F.col("step_idx") < F.col("steps") - 1,
    })


def narrative_rows(events: DataFrame) -> DataFrame:
    """A row per event and narrative that it belongs to, by the id of its association."""
    stories = F.filter("associations", lambda a: a["mode"] == fixed.NARRATIVE)
    ids = F.transform(stories, lambda a: a["id"])
    return events.withColumn("narrative_id", F.explode(ids))


def narrative_steps(
    events: DataFrame, order: Sequence[str] = ORDER, rows_per_bucket: int | None = None
) -> DataFrame:
    """The steps of every narrative that has any."""
    return steps_in_order(narrative_rows(events), order, rows_per_bucket)


def narrative_from_filters(
    events: DataFrame, paths: Sequence[str], order: Sequence[str] = ORDER
) -> DataFrame:
    """One narrative of all events that carry any of the filter paths, named after them."""
    chosen = events.where(matches_filters(paths)) if paths else events.limit(0)
    return steps_in_order(chosen.withColumn("narrative_id", F.lit("-".join(paths))), order)


def step_of(steps: DataFrame, selected: DataFrame, key: str = "event_key") -> DataFrame:
    """Place of the selected event in each narrative; of several, the last."""
    return (
        steps.join(selected.select(key).distinct(), key)
        .groupBy("narrative_id", key)
        .agg(F.max("step_idx").alias("step_idx"))
    )


def step_at(steps: DataFrame, number: int) -> DataFrame:
    """The step with this number in each narrative; out of range gives none."""
    return steps.where(F.col("step_idx") == number)


def first_step_of(steps: DataFrame, selected: DataFrame, key: str = "event_key") -> DataFrame:
    """First place of an event in each narrative."""
    return (
        steps.join(selected.select(key).distinct(), key)
        .groupBy("narrative_id", key)
        .agg(F.min("step_idx").alias("step_idx"))
    )


def narrative_legs(steps: DataFrame) -> DataFrame:
    """Leg from each step to the next; none where either end has no coordinates."""
    there = (F.col("next.latitude") != "") & (F.col("next.longitude") != "")
    return steps.where(is_located() & there).select(
        "narrative_id",
        "step_idx",
        F.col("event_key").alias("from_key"),
        F.col("next.event_key").alias("to_key"),
        F.col("latitude").alias("from_latitude"),
        F.col("longitude").alias("from_longitude"),
        F.col("next.latitude").alias("to_latitude"),
        F.col("next.longitude").alias("to_longitude"),
    )


def marked_steps(events: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Steps whose style is not ``None``; legs bridge the others. The style of an event's
    n-th narrative is the n-th of its step styles."""
    stories = F.filter("associations", lambda a: a["mode"] == fixed.NARRATIVE)
    styled = events.select(
        "*", F.posexplode(F.transform(stories, lambda a: a["id"])).alias("_place", "narrative_id")
    ).withColumn("step_style", F.get("narrative___stepStyles", F.col("_place")))
    marked = styled.where(~F.col("step_style").eqNullSafe("None")).drop("_place")
    return steps_in_order(marked, order)


def narrative_extent(
    rows: DataFrame,
    limits: tuple[dt.datetime, dt.datetime] | None = None,
    key: str = "narrative_id",
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Map box and time range of each narrative, from its rows in any order.

    The box holds the located steps and is widened so that the first step, if located,
    is its centre; without a located step the corners stay crossed at +-180. The time
    range is that of ``limits`` widened to the steps, plus a tenth on either side.
    """
    lat = F.when(is_located(), to_number("latitude"))
    lon = F.when(is_located(), to_number("longitude"))
    start_at = F.struct(*order, lat.alias("lat"), lon.alias("lon"))
    groups = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("steps"),
        F.coalesce(F.least(F.min(lat), F.lit(180.0)), F.lit(180.0)).alias("south"),
        F.coalesce(F.greatest(F.max(lat), F.lit(-180.0)), F.lit(-180.0)).alias("north"),
        F.coalesce(F.least(F.min(lon), F.lit(180.0)), F.lit(180.0)).alias("west"),
        F.coalesce(F.greatest(F.max(lon), F.lit(-180.0)), F.lit(-180.0)).alias("east"),
        F.min(start_at).alias("first"),
        F.min(F.unix_millis(F.col("datetime").cast("timestamp"))).alias("lo"),
        F.max(F.unix_millis(F.col("datetime").cast("timestamp"))).alias("hi"),
    )
    lo, hi = F.col("lo"), F.col("hi")
    if limits is not None:
        lo = F.least(lo, F.unix_millis(F.lit(limits[0]).cast("timestamp")))
        hi = F.greatest(hi, F.unix_millis(F.lit(limits[1]).cast("timestamp")))
    start = lo - (hi - lo) / 10
    south, north = _centred("south", "north", "first.lat")
    west, east = _centred("west", "east", "first.lon")
    return groups.select(
        key,
        "steps",
        south.alias("south"),
        west.alias("west"),
        north.alias("north"),
        east.alias("east"),
        start.alias("start_ms"),
        (hi + (hi - start) / 10).alias("end_ms"),
    )


def _centred(low: str, high: str, middle: str) -> tuple[Column, Column]:
    """Push out the nearer side until ``middle`` is the centre; null middle changes nothing."""
    low, high, middle = F.col(low), F.col(high), F.col(middle)
    below, above = F.abs(middle - low), F.abs(middle - high)
    new_low = F.when(below < above, middle - above).otherwise(low)
    new_high = F.when(below > above, middle + below).otherwise(high)
    return new_low, new_high


def neighbours(
    events: DataFrame,
    keys: Sequence[str] = (),
    order: Sequence[str] = ORDER,
    key: str = "event_key",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Key of the previous and the next event in time, over all events or within ``keys``."""
    return numbered(
        events, keys, order,
        index="_idx",
        following={"next_key": F.col(key)},
        preceding={"previous_key": F.col(key)},
        **_cut(events, order, rows_per_bucket),
    ).drop("_idx")


def region_segments(regions: DataFrame) -> DataFrame:
    """A region's outline as segments between consecutive points."""
    starts = F.posexplode(F.slice("points", F.lit(1), F.greatest(F.size("points") - 1, F.lit(0))))
    return regions.select("name", "points", starts.alias("segment_idx", "a")).select(
        "name",
        "segment_idx",
        F.col("a.lat").alias("lat1"),
        F.col("a.lon").alias("lon1"),
        F.element_at("points", F.col("segment_idx") + 2)["lat"].alias("lat2"),
        F.element_at("points", F.col("segment_idx") + 2)["lon"].alias("lon2"),
    )
