"""Sessions of a raw log: cleaning, grouping, stage, and one event per session.

The log has a row per log event with ``session``, ``eventid``, ``timestamp`` and a
position ``pos`` that settles ties; other columns are optional. Every aggregate is a
minimum, maximum or sum, so partial results combine before the shuffle and a session of
any size costs one row per task.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from eventscope import fixed_values as fixed
from eventscope.functions.values import blank_to_null, to_number
from eventscope.operators.once import computed
from eventscope.operators.ordering import numbered

RECORD_COLUMNS = ["record_src_ip", "location", "latitude", "longitude"]
_FIRST = ["timestamp", "src_ip", "sensor", "uuid", "protocol"]
_CONNECT = ["src_port", "dst_ip", "dst_port"]
_CLOSED = ["duration"]


def clean_log(log: DataFrame) -> DataFrame:
    """Log events with an event id and a readable time; adds ``ts`` and ``ms``."""
    log = log.where(F.col("eventid") != "")
    if isinstance(log.schema["timestamp"].dataType, T.StringType):
        log = computed(log, {"ts": F.try_to_timestamp(F.col("timestamp"))})
    else:
        log = log.withColumn("ts", F.col("timestamp").cast("timestamp"))
    return log.where(F.col("ts").isNotNull()).withColumn("ms", F.unix_millis("ts"))


def stage_number(eventid="eventid", ladder=fixed.STAGES) -> Column:
    """Place on the ladder of the furthest step this event stands for."""
    column = F.col(eventid) if isinstance(eventid, str) else eventid
    number = F.lit(len(ladder) - 1)
    for place, (_, ids, prefixes) in reversed(list(enumerate(ladder))):
        test = column.isin(list(ids)) if ids else F.lit(False)
        for prefix in prefixes:
            test |= column.startswith(prefix)
        number = F.when(test, place).otherwise(number)
    return number


def stage_name(number, ladder=fixed.STAGES) -> Column:
    names = F.array(*[F.lit(stage) for stage, _, _ in ladder])
    return F.element_at(names, F.col(number) + 1)


def derive_stage(log: DataFrame, keys: Sequence[str] = ("session",), ladder=fixed.STAGES) -> DataFrame:
    """Furthest step of each session."""
    return (
        log.groupBy(*keys)
        .agg(F.min(stage_number(ladder=ladder)).alias("_stage"))
        .select(*keys, stage_name("_stage", ladder).alias("stage"))
    )


def _parts(log, connect, closed, ladder) -> list[Column]:
    """Each struct is as narrow as the log allows: columns it lacks are not carried."""
    order = ["ms", "pos"]
    kind = F.col("eventid")

    def carried(names):
        return [n for n in names if n in log.columns]

    record = carried(RECORD_COLUMNS)
    return [
        F.min(F.struct(*order, "ts", *carried(_FIRST))).alias("first"),
        F.max(F.struct(*order, "ts", "timestamp")).alias("last"),
        F.min(F.when(kind == connect, F.struct(*order, *carried(_CONNECT)))).alias("connect"),
        F.min(F.when(kind == closed, F.struct(*order, *carried(_CLOSED)))).alias("closed"),
        F.min(stage_number(ladder=ladder)).alias("stage_number"),
        F.count(F.lit(1)).alias("event_count"),
        *([F.max(F.struct(*record)).alias("record")] if record else []),
    ]


def session_parts(
    log: DataFrame,
    keys: Sequence[str] = ("session",),
    connect: str = fixed.CONNECT,
    closed: str = fixed.CLOSED,
    ladder=fixed.STAGES,
) -> DataFrame:
    """What a piece of the log says about each session; pieces merge in any order."""
    return log.groupBy(*keys).agg(*_parts(log, connect, closed, ladder))


def _merging(parts: DataFrame) -> list[Column]:
    return [
        *[F.min(c).alias(c) for c in ("first", "connect", "closed", "stage_number")],
        *[F.max(c).alias(c) for c in ("last", "record") if c in parts.columns],
        F.sum("event_count").alias("event_count"),
    ]


def merge_parts(parts: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    return parts.groupBy(*keys).agg(*_merging(parts))


def sessions_from_parts(parts: DataFrame, keys: Sequence[str] = ("session",), ladder=fixed.STAGES) -> DataFrame:
    """The session row. An empty text counts as missing, but for the ports."""
    def field(part: str, name: str) -> Column:
        carried = part in parts.columns and name in parts.schema[part].dataType.names
        return F.col(f"{part}.{name}") if carried else F.lit(None).cast("string")

    span = (F.col("last.ms") - F.col("first.ms")) / 1000
    kept = [c for c in ("event_ids",) if c in parts.columns]
    return parts.select(
        *keys,
        F.coalesce(blank_to_null(field("record", "record_src_ip")), blank_to_null(field("first", "src_ip"))).alias("src_ip"),
        *[blank_to_null(field("record", c)).alias(c) for c in ("location", "latitude", "longitude")],
        *[blank_to_null(field("first", c)).alias(c) for c in ("sensor", "uuid", "protocol")],
        field("connect", "src_port").alias("src_port"),
        blank_to_null(field("connect", "dst_ip")).alias("dst_ip"),
        field("connect", "dst_port").alias("dst_port"),
        F.col("first.timestamp").alias("start_timestamp"),
        F.col("last.timestamp").alias("end_timestamp"),
        F.col("first.ts").alias("start_datetime"),
        F.col("last.ts").alias("end_datetime"),
        F.coalesce(to_number(field("closed", "duration")), span).alias("duration_sec"),
        *kept,
        "event_count",
        stage_name("stage_number", ladder).alias("stage"),
    )


def build_sessions(
    log: DataFrame,
    keys: Sequence[str] = ("session",),
    connect: str = fixed.CONNECT,
    closed: str = fixed.CLOSED,
    ladder=fixed.STAGES,
    event_ids: bool = False,
    event_order: Sequence[str] = fixed.EVENT_ORDER,
) -> DataFrame:
    """One row per session of a clean log.

    With ``event_ids``, also the session's event types in display order. Then the log is
    grouped by session and type first, and the second grouping sees one row per type.
    """
    if not event_ids:
        return sessions_from_parts(session_parts(log, keys, connect, closed, ladder), keys, ladder)
    by_type = session_parts(log, [*keys, "eventid"], connect, closed, ladder)
    return sessions_from_parts(parts_with_types(by_type, keys, event_order), keys, ladder)


def parts_with_types(
    by_type: DataFrame, keys: Sequence[str] = ("session",), event_order: Sequence[str] = fixed.EVENT_ORDER
) -> DataFrame:
    """Parts of sessions from parts of their event types, with ``event_ids`` in display order."""
    shown = F.struct(
        type_rank("eventid", event_order).alias("rank"),
        F.struct("first.ms", "first.pos").alias("seen"),
        "eventid",
    )
    return by_type.groupBy(*keys).agg(
        *_merging(by_type),
        # As long as the list of event types, not as the session.
        F.transform(F.array_sort(F.collect_list(shown)), lambda g: g["eventid"]).alias("event_ids"),
    )


def type_rank(eventid="eventid", event_order: Sequence[str] = fixed.EVENT_ORDER) -> Column:
    """Place of an event type in the display order; types not listed share the last place."""
    places = F.array(*[F.lit(e) for e in event_order])
    found = F.array_position(places, F.col(eventid))
    return F.when(found > 0, found - 1).otherwise(len(event_order)).cast("int")


def session_groups(
    log: DataFrame,
    keys: Sequence[str] = ("session",),
    event_order: Sequence[str] = fixed.EVENT_ORDER,
) -> DataFrame:
    """A session's event types in display order, with their counts.

    The window runs over one row per session and type, not over the log.
    """
    groups = log.groupBy(*keys, "eventid").agg(
        F.count(F.lit(1)).alias("event_count"), F.min(F.struct("ms", "pos")).alias("seen")
    )
    return _shown_groups(groups, keys, event_order)


def groups_from_parts(
    by_type: DataFrame, keys: Sequence[str] = ("session",), event_order: Sequence[str] = fixed.EVENT_ORDER
) -> DataFrame:
    """``session_groups`` from parts by session and event type."""
    groups = by_type.select(*keys, "eventid", "event_count", F.struct("first.ms", "first.pos").alias("seen"))
    return _shown_groups(groups, keys, event_order)


def _shown_groups(groups: DataFrame, keys: Sequence[str], event_order: Sequence[str]) -> DataFrame:
    shown = Window.partitionBy(*keys).orderBy(type_rank("eventid", event_order), "seen")
    return groups.withColumn("group_idx", F.row_number().over(shown) - 1).select(
        *keys, "group_idx", "eventid", "event_count"
    )


def occurrence_index(
    log: DataFrame, keys: Sequence[str] = ("session",), rows_per_bucket: int | None = None
) -> DataFrame:
    """Number of each log event among those of its type in its session, from 0. A session
    may hold most of the log; it is numbered day by day or, if ``rows_per_bucket`` is given,
    by buckets of about so many rows, however they lie in time."""
    days = F.floor(F.col("ms") / 86_400_000)
    cut = {"bucket": days} if rows_per_bucket is None else {"along": F.col("ms"), "rows_per_bucket": rows_per_bucket}
    return numbered(log, [*keys, "eventid"], ["ms", "pos"], index="occurrence", **cut)


def sessions_to_events(
    sessions: DataFrame,
    date_format: str = fixed.DATE_FORMAT,
    time_format: str = fixed.TIME_FORMAT,
    colours: dict[str, str] = fixed.STAGE_COLOURS,
    key: str = "session",
    kept: Sequence[str] = (),
) -> DataFrame:
    """One event per session; ``sessions`` must have its ``event_ids``. ``kept`` names
    further columns to pass on."""
    source = F.when(
        F.col("src_port").isNotNull(),
        F.concat(F.coalesce("src_ip", F.lit("null")), F.lit(":"), F.col("src_port").cast("string")),
    ).otherwise(F.col("src_ip"))
    target = F.when(
        F.col("dst_ip").isNotNull() & F.col("dst_port").isNotNull(),
        F.concat(F.lit("> "), "dst_ip", F.lit(":"), F.col("dst_port").cast("string")),
    )
    palette = F.lit(None).cast("string")
    for stage, colour in colours.items():
        palette = F.when(F.col("stage") == stage, colour).otherwise(palette)
    blank = F.lit("")
    return sessions.select(
        *kept,
        F.col(key).alias("id"),
        F.col(key).alias("civ_id"),
        F.concat_ws(" ", key, source, target, "protocol").alias("description"),
        F.date_format("start_datetime", date_format).alias("date"),
        F.date_format("start_datetime", time_format).alias("time"),
        F.lit("second").alias("time_precision"),
        F.col("start_timestamp").cast("string").alias("time_display"),
        *[F.coalesce(c, blank).alias(c) for c in ("location", "latitude", "longitude")],
        *[F.col("stage").alias(c) for c in ("type", "category", "category_full")],
        F.concat(F.array(F.concat(F.lit(fixed.STAGE_PREFIX), "stage")), "event_ids").alias("associations"),
        F.array().cast("array<string>").alias("sources"),
        blank.alias("comments"),
        blank.alias("shape"),
        palette.alias("colour"),
        F.col("start_datetime"),
        F.col(key).alias("session"),
    )


def log_to_events(log: DataFrame, keys: Sequence[str] = ("session",), key: str = "session", **options) -> DataFrame:
    """Log to events in one go; sort by ``start_datetime`` only when writing them out."""
    built = build_sessions(clean_log(log), keys, event_ids=True)
    return sessions_to_events(built, key=key, kept=[k for k in keys if k != key], **options)


def session_header(sessions: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """The session's header as (place, field, value) rows, absent and empty ones left out."""
    duration = F.col("duration_sec")
    whole = F.when(duration == F.floor(duration), F.floor(duration).cast("string"))
    fields = [
        ("src_ip", F.col("src_ip")),
        ("src_port", F.col("src_port")),
        ("dst_ip", F.col("dst_ip")),
        ("dst_port", F.col("dst_port")),
        ("protocol", F.col("protocol")),
        ("location", F.col("location")),
        ("latitude", F.col("latitude")),
        ("longitude", F.col("longitude")),
        ("timestamp", F.col("start_timestamp")),
        ("duration", F.coalesce(whole, duration.cast("string"))),
        ("sensor", F.col("sensor")),
        ("uuid", F.col("uuid")),
    ]
    rows = F.array(*[
        F.struct(
            F.lit(place).alias("place"),
            F.lit(name).alias("field"),
            value.cast("string").alias("value"),
        )
        for place, (name, value) in enumerate(fields)
    ])
    return sessions.select(*keys, F.inline(rows)).where(F.col("value") != "")


def session_cards(events: DataFrame) -> DataFrame:
    """Selected events that carry a session."""
    return events.where(F.col("session").isNotNull())
