"""Row predicates: time, tags, shape, text, box."""

import datetime as dt

from pyspark.sql import Column, functions as F

from eventscope import fixed_values as fixed
from eventscope.functions.paths import path_text
from eventscope.functions.values import column, is_nonlocated, to_number


def in_range(start, end, time="datetime", keep_nonlocated=False, day=None) -> Column:
    """Strictly between two times, given as text or as values of the column's own type, so
    that the scan can use them. ``day`` names a date partition column to prune by."""
    inside = (column(time) > F.lit(start)) & (column(time) < F.lit(end))
    if day is not None:
        inside &= column(day).between(F.lit(_date(start)), F.lit(_date(end)))
    return is_nonlocated() | inside if keep_nonlocated else inside


def _date(value) -> dt.date:
    return value.date() if isinstance(value, dt.datetime) else dt.date.fromisoformat(str(value)[:10])


def matches_filters(paths, associations="associations") -> Column:
    """Carries any of these filter paths; no paths means all rows pass."""
    paths = list(paths)
    if not paths:
        return F.lit(True)
    return _any_association(
        associations,
        lambda a: (a["mode"] == fixed.FILTER) & path_text(a["filter_paths"]).isin(paths),
    )


def matches_categories(titles, associations="associations") -> Column:
    """Carries any of these category titles; no titles means all rows pass."""
    titles = list(titles)
    if not titles:
        return F.lit(True)
    return _any_association(
        associations, lambda a: (a["mode"] == fixed.CATEGORY) & a["title"].isin(titles)
    )


def _any_association(associations, test) -> Column:
    return F.coalesce(F.exists(column(associations), test), F.lit(False))


def matches_associations(paths, titles, associations="associations") -> Column:
    return matches_filters(paths, associations) & matches_categories(titles, associations)


def matches_shapes(ids, shape="shape") -> Column:
    return F.coalesce(column(shape)["id"].isin(list(ids)), F.lit(False))


def matches_text(query: str, columns=tuple(fixed.SEARCH_COLUMNS)) -> Column:
    """Case-blind substring in any column; an empty query finds nothing."""
    found = F.lit(False)
    if query:
        for name in columns:
            found |= F.coalesce(F.lower(column(name)).contains(query.lower()), F.lit(False))
    return found


def in_box(west, south, east, north, latitude="latitude", longitude="longitude") -> Column:
    """Inside a map box; a box with west > east runs across the date line."""
    lat, lon = to_number(latitude), to_number(longitude)
    if east - west >= 360:
        across = F.lit(True)
    elif west <= east:
        across = lon.between(west, east)
    else:
        across = (lon >= west) | (lon <= east)
    return F.coalesce(lat.between(south, north) & across, F.lit(False))


def active_categories(titles, associations="associations") -> Column:
    """Titles of the row's categories that are active, in the row's order."""
    titles = list(titles)
    if not titles:
        return F.array().cast("array<string>")
    mine = F.filter(
        F.coalesce(column(associations), F.array()),
        lambda a: (a["mode"] == fixed.CATEGORY) & a["title"].isin(titles),
    )
    return F.transform(mine, lambda a: a["title"])
