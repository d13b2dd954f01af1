"""The main query: which events a view shows."""

from pyspark.sql import Column, DataFrame, functions as F

from eventscope import fixed_values as fixed
from eventscope.functions import predicates as p
from eventscope.functions.paths import path_text
from eventscope.functions.values import is_located
from eventscope.plans.view import View


def visible(view: View, day: str | None = None) -> Column:
    """Events of type SHAPE need an active shape, others an active filter; all need an
    active category and the time range."""
    shape_event = F.coalesce(F.col("type") == fixed.SHAPE, F.lit(False))
    tagged = p.matches_filters(view.filters)
    own = F.when(shape_event, p.matches_shapes(view.shapes)).otherwise(tagged)
    return (
        p.in_range(view.start, view.end, keep_nonlocated=view.keep_nonlocated, day=day)
        & p.matches_categories(view.categories)
        & own
    )


def select_events(events: DataFrame, view: View, day: str | None = None) -> DataFrame:
    return events.where(visible(view, day))


def count_located(events: DataFrame, view: View, unit: str = "events") -> DataFrame:
    """Number of shown events that have coordinates, and what they are: ``unit`` is
    "attack sessions" when each event stands for a session."""
    located = select_events(events, view).where(is_located())
    return located.agg(F.count(F.lit(1)).alias("events")).withColumn("unit", F.lit(unit))


def with_any_active(
    events: DataFrame, active: DataFrame, mode: str = fixed.FILTER, key: str = "event_key"
) -> DataFrame:
    """Events that carry any active filter path or category title, for sets too long to
    list: ``active`` has one column with the paths or titles."""
    mine = F.filter("associations", lambda a: a["mode"] == mode)
    if mode == fixed.FILTER:
        names = F.transform(mine, lambda a: path_text(a["filter_paths"]))
    else:
        names = F.transform(mine, lambda a: a["title"])
    tags = events.select(key, F.explode(names).alias("_name"))
    wanted = active.toDF("_name").distinct()
    tagged = tags.join(wanted, "_name", "left_semi").select(key)
    return events.join(tagged, key, "left_semi")


def search(events: DataFrame, query: str, columns=tuple(fixed.SEARCH_COLUMNS)) -> DataFrame:
    return events.where(p.matches_text(query, columns))


def timeline_events(events: DataFrame, payload: tuple[str, ...] = ("session", "raw", "events")) -> DataFrame:
    """Without the session's log, so that a scan need not read it."""
    return events.drop(*payload)


def track_rows(events: DataFrame, titles, fallback: str | None = None) -> DataFrame:
    """A row per event and active category; an event with none gets one row, on the track
    of its own ``category`` column if ``fallback`` names it."""
    other = F.col(fallback) if fallback else F.lit(None).cast("string")
    tracks = events.withColumn("track", F.explode_outer(p.active_categories(titles)))
    return tracks.withColumn("track", F.coalesce("track", other))
