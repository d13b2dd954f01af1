"""From a view to what it shows: map, timeline, cards."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from eventscope.operators import groups, links, logfields, selection, sessions, spatial, timeline
from eventscope.plans.view import View


def map_view(events: DataFrame, view: View, zooms: Sequence[int] = spatial.ZOOMS) -> DataFrame:
    """Clusters of the places of the shown events."""
    shown = selection.select_events(events, view)
    return spatial.cluster(spatial.project(groups.group_locations(shown)), zooms)


def timeline_view(
    events: DataFrame, view: View, minutes: int, fallback: str | None = None
) -> DataFrame:
    """Shown events counted per track and time window."""
    shown = selection.select_events(events, view)
    return timeline.activity(selection.track_rows(shown, view.categories, fallback), minutes)


def project_lanes(events: DataFrame, view: View, project: str | None = None, lane_size: int = 1) -> DataFrame:
    """Lanes of the shown projects; an event without a place counts with its project."""
    shown = selection.select_events(events, view)
    return timeline.assign_lanes(groups.project_spans(shown, project), lane_size)


def card_log(log: DataFrame, keys: DataFrame, key: str = "session") -> DataFrame:
    """Raw log of the selected sessions only."""
    return log.join(keys.select(key).distinct(), key, "left_semi")


def card_sections(log: DataFrame, keys: DataFrame, schema: DataFrame, key: str = "session") -> DataFrame:
    """Log events of the selected sessions with their place in their section and the names
    of the fields that are shown and of those that are absent."""
    entries = sessions.occurrence_index(card_log(log, keys, key), [key])
    return logfields.field_coverage(entries, schema)


def card_values(log: DataFrame, keys: DataFrame, key: str = "session") -> DataFrame:
    """Field values of the selected sessions' log events."""
    return logfields.explode_fields(card_log(log, keys, key), keys=[key, "pos"])


def selected_events(events: DataFrame, keys: DataFrame, sources: DataFrame, key: str = "session") -> DataFrame:
    """A saved selection: its events in the order of the list, with their sources."""
    return links.attach_sources(links.by_keys(events, keys, key), sources)
