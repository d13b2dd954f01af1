"""Counts and spans by place, project and colour."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from eventscope import fixed_values as fixed
from eventscope.functions.paths import path_text
from eventscope.functions.values import (
    has_valid_coordinates, is_nonlocated, media_type,
)

LOCATION = ["location", "latitude", "longitude"]


def location_label() -> Column:
    return F.concat(
        F.coalesce("location", F.lit("undefined")), F.lit("$_"), "latitude", F.lit("_"), "longitude"
    )


def located_events(events: DataFrame) -> DataFrame:
    """Events on the map with their location's ``label``: the members of ``group_locations``."""
    return events.where(has_valid_coordinates()).withColumn("label", location_label())


def group_locations(events: DataFrame, key: str = "event_key") -> DataFrame:
    """One row per place; ``location_id`` is the first event's key. Members stay in
    ``located_events``, to be joined on ``label``."""
    return (
        events.where(has_valid_coordinates())
        .groupBy(*LOCATION)
        .agg(F.min(key).alias("location_id"), F.count(F.lit(1)).alias("events"))
        .withColumn("label", location_label())
    )


def first_filter_path() -> Column:
    """The path of an event's first filter; null without one."""
    filters = F.filter("associations", lambda a: a["mode"] == fixed.FILTER)
    return path_text(F.get(filters, F.lit(0))["filter_paths"])


def project_spans(
    events: DataFrame, key: str | None = None, order: str = "event_key", time: str = "datetime"
) -> DataFrame:
    """First and last time of the non-located events of each project, and the category of
    its first event. An event's project is in the column ``key``, or else the path of its
    first filter."""
    project = F.col(key) if key else first_filter_path()
    return (
        events.where(is_nonlocated() & project.isNotNull())
        .groupBy(project.alias("project"))
        .agg(
            F.min(time).alias("start"),
            F.max(time).alias("end"),
            F.min_by("category", order).alias("category"),
            F.min(order).alias("first_key"),
        )
    )


def set_hits(sets: Sequence[Sequence[str]], associations: str = "associations") -> list[Column]:
    """Per colour set, how many of a row's associations are in it; a path in two sets
    belongs to the last."""
    home = {path: place for place, paths in enumerate(sets) for path in paths}
    hits = []
    for place in range(len(sets)):
        paths = [path for path, at in home.items() if at == place]
        if paths:
            mine = F.filter(associations, lambda a: path_text(a["filter_paths"]).isin(paths))
            hits.append(F.coalesce(F.size(mine), F.lit(0)))
        else:
            hits.append(F.lit(0))
    return hits


def colour_hits(events: DataFrame, key: str | Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """Hits of each colour set per group, as columns ``n0``, ``n1``, ...

    Plain sums: nothing is exploded, and groups add up before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    sums = [F.sum(h).alias(f"n{i}") for i, h in enumerate(set_hits(sets))]
    return events.groupBy(*keys).agg(*sums) if sums else events.select(*keys).distinct()


def shares_of_hits(hits: DataFrame, key: str | Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """Hits of smaller groups added up by ``key``, as (set_idx, hits, share) rows.

    Without sets or hits there is one row with the whole share.
    """
    keys = [key] if isinstance(key, str) else list(key)

    def row(place, n, share):
        return F.struct(
            F.lit(place).alias("set_idx"), n.cast("long").alias("hits"), share.cast("double").alias("share")
        )

    whole = F.array(row(0, F.lit(0), F.lit(1.0)))
    if not sets:
        return hits.select(*keys).distinct().select(*keys, F.inline(whole))
    names = [f"n{i}" for i in range(len(sets))]
    groups = hits.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    total = sum([F.col(n) for n in names[1:]], F.col(names[0]))
    dense = F.array(*[row(i, F.col(n), F.try_divide(F.col(n), total)) for i, n in enumerate(names)])
    return groups.select(*keys, F.inline(F.when(total > 0, dense).otherwise(whole)))


def colour_shares(events: DataFrame, key: str | Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """Share of each colour set in each group's hits."""
    return shares_of_hits(colour_hits(events, key, sets), key, sets)


def categories_by_panel(categories: DataFrame, panels: Sequence[str]) -> DataFrame:
    """Categories with their ``panel``: the first path part, or one panel for all."""
    panel = F.get("filter_paths", F.lit(0)) if len(panels) > 1 else F.lit("default")
    return categories.withColumn("panel", panel)


def media_type_counts(sources: DataFrame, paths: str = "paths", key: str = "source_id") -> DataFrame:
    """Per source, how many of its paths are of each type."""
    listed = sources.select(key, F.explode(paths).alias("path"))
    return listed.groupBy(key, media_type("path").alias("media_type")).agg(
        F.count(F.lit(1)).alias("paths")
    )
