"""Scalars: blanks, numbers, coordinates, dates, media types."""

import re

from pyspark.sql import Column, functions as F

from eventscope import fixed_values as fixed

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    """Missing and empty text both count as absent."""
    return F.nullif(column(c), F.lit(""))


def to_number(c) -> Column:
    """Text as a number: absent or not a number is null, whitespace alone is 0."""
    raw = column(c).cast("string")
    text = F.trim(raw)
    return (
        F.when(raw == "", F.lit(None))
        .when(text == "", F.lit(0.0))
        .when(text.rlike(_NUMBER), text.try_cast("double"))
    )


def decimal_point(c) -> Column:
    """First comma becomes a point."""
    return F.regexp_replace(column(c), "^([^,]*),", "$1.")


def _within(c, limit: int) -> Column:
    return F.coalesce(F.abs(to_number(c)) <= limit, F.lit(False))


def is_latitude(c) -> Column:
    return _within(c, 90)


def is_longitude(c) -> Column:
    return _within(c, 180)


def has_valid_coordinates(latitude="latitude", longitude="longitude") -> Column:
    return is_latitude(latitude) & is_longitude(longitude)


def is_located(latitude="latitude", longitude="longitude") -> Column:
    """Both coordinates are given; their range is not tested."""
    return blank_to_null(latitude).isNotNull() & blank_to_null(longitude).isNotNull()


def is_nonlocated(latitude="latitude", longitude="longitude") -> Column:
    """Neither coordinate is given."""
    return blank_to_null(latitude).isNull() & blank_to_null(longitude).isNull()


def _lenient(fmt: str) -> str:
    """Accept one-digit parts wherever the format asks for two."""
    return re.sub(r"([MdHhms])\1", r"\1", fmt)


def _leading_text(fmt: str) -> str:
    """Pattern of the text that ``fmt`` reads; what follows it is ignored."""
    parts = re.findall(r"y+|[A-Za-z]+|[^A-Za-z]+", fmt)
    def one(part):
        if part[0] == "y":
            return r"\d{%d}" % len(part)
        if part[0].isalpha():
            return r"\d{1,2}"
        return re.escape(part)

    return r"^\s*(" + "".join(map(one, parts)) + ")"


def event_time(date, time, date_format=fixed.DATE_FORMAT, time_format=fixed.TIME_FORMAT) -> Column:
    """Timestamp of a date and time text; no time is midnight, unreadable text is null."""
    fmt = f"{date_format} {time_format}"
    midnight = re.sub(r"[A-Za-z]+", "00", time_format)
    text = F.concat(column(date), F.lit(" "), F.coalesce(blank_to_null(time), F.lit(midnight)))
    return F.try_to_timestamp(F.regexp_extract(text, _leading_text(fmt), 1), F.lit(_lenient(fmt)))


def nice_date(ts) -> Column:
    return F.date_format(column(ts), "dd MMMM, yyyy")


def earlier(*times) -> Column:
    return F.least(*map(column, times))


def later(*times) -> Column:
    return F.greatest(*map(column, times))


def media_type(path, types=fixed.MEDIA_TYPES) -> Column:
    """Type of a media path by its ending or host."""
    path = F.trim(column(path))
    found = F.lit("Unknown")
    for pattern, name in reversed(types):
        found = F.when(path.rlike(pattern), name).otherwise(found)
    return found


def media_type_short(path) -> Column:
    """The narrower list of types; the path is taken as it is."""
    found = F.lit("Unknown")
    for pattern, name in reversed(fixed.MEDIA_TYPES_SHORT):
        found = F.when(column(path).rlike(pattern), name).otherwise(found)
    return found


def tweet_id(url) -> Column:
    return F.regexp_extract(column(url), fixed.TWEET_ID, 1)
