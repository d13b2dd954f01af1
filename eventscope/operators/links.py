"""Links: ids to objects, events to events."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from eventscope.operators.contracts import messages, split_by_errors

def resolve_refs(
    df: DataFrame,
    refs: str,
    table: DataFrame,
    *,
    key: str = "id",
    fields: Sequence[str] | None = None,
    keep_unknown: bool = False,
    into: str | None = None,
) -> DataFrame:
    """Replace a list of ids by the objects they name, in order.

    Unknown ids go, or stay as null with ``keep_unknown``; so does a null id. ``table`` must
    have unique keys (``first_definitions``). Each list that occurs is resolved once, by a
    join on its ids, and joined back by the list; no key of the rows is needed, and rows
    that are alike stay what they are.
    """
    into = into or refs
    fields = list(fields or table.columns)
    objects = table.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_ref"), F.struct(*fields).alias("_object")
    )
    lists = df.select(F.col(refs).alias("_list")).where(F.size(refs) > 0).distinct()
    parts = lists.select("_list", F.posexplode("_list").alias("_place", "_ref")).join(
        objects, "_ref", "left" if keep_unknown else "inner"
    )
    # As long as the list.
    gathered = parts.groupBy("_list").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_place", "_object"))), lambda p: p["_object"]
        ).alias("_objects")
    )
    empty = F.array().cast(_array_type(table, fields))
    return (
        df.join(gathered, F.col(refs).eqNullSafe(F.col("_list")), "left")
        .withColumn(into, F.coalesce("_objects", empty))
        .drop("_list", "_objects")
    )


def _array_type(table: DataFrame, fields) -> str:
    return f"array<{_object_type(table, fields)}>"


def _object_type(table: DataFrame, fields) -> str:
    return table.select(F.struct(*fields).alias("o")).schema["o"].dataType.simpleString()


def attach_sources(df: DataFrame, sources: DataFrame, key: str = "source_id", **options) -> DataFrame:
    """Events with their source rows; an unknown id keeps its place as null."""
    return resolve_refs(df, "sources", sources, key=key, keep_unknown=True, **options)


def join_shape(df: DataFrame, shapes: DataFrame) -> DataFrame:
    """Adds the shape row that ``shape`` names as ``shape_row``; null if there is none."""
    known = shapes.select(
        F.col("id").alias("shape"), F.struct("id", "title", "shape", "colour").alias("shape_row")
    )
    return df.join(known, "shape", "left")


def unknown_shape() -> Column:
    """An event names a shape, and ``join_shape`` found none."""
    return F.coalesce(F.col("shape") != "", F.lit(False)) & F.col("shape_row").isNull()


def resolve_shape(df: DataFrame, shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shape id to shape row; an event that names an unknown shape is set aside."""
    errors = messages([(unknown_shape(), "shape is not known")])
    ok, rejects = split_by_errors(join_shape(df, shapes), "events", errors)
    return ok.withColumn("shape", F.col("shape_row")).drop("shape_row"), rejects


def coevents(df: DataFrame, selected: DataFrame, time: str = "datetime", key: str = "event_key") -> DataFrame:
    """Events at an instant at which a selected event happened, each once, with
    ``is_selected``. For one selected event these are itself and its co-events."""
    chosen = selected.select(F.col(key).alias("_key"), F.col(time).alias("_time")).distinct()
    instants = chosen.select(F.col("_time").alias(time)).distinct()
    at = df.join(instants, time, "left_semi")
    keys = chosen.select("_key", F.lit(True).alias("is_selected"))
    return (
        at.join(keys, at[key] == keys["_key"], "left")
        .drop("_key")
        .withColumn("is_selected", F.coalesce("is_selected", F.lit(False)))
    )


def coevent_counts(df: DataFrame, time: str = "datetime") -> DataFrame:
    """Instants with more than one event, and how many."""
    counts = df.groupBy(time).agg(F.count(F.lit(1)).alias("events"))
    return counts.where(F.col("events") > 1)


def neighbourhood(df: DataFrame, anchors: DataFrame, minutes: int, time: str = "datetime") -> DataFrame:
    """Events less than half of ``minutes`` away from an anchor, each once.

    Time is cut into buckets as wide as the reach. An anchor in the event's own bucket is
    always near enough; of the buckets beside it only the last and the first anchor
    matter. So each bucket needs one row, however many anchors it holds.
    """
    reach = (minutes // 2) * 60_000
    if reach == 0:
        return df.limit(0)

    def millis(c):
        return F.unix_millis(F.col(c).cast("timestamp"))

    def bucket(ms):
        return F.floor(ms / F.lit(reach))

    ms = millis(time)
    spans = (
        anchors.select(ms.alias("_ms"))
        .where(F.col("_ms").isNotNull())
        .groupBy(bucket(F.col("_ms")).alias("_bucket"))
        .agg(F.min("_ms").alias("_first"), F.max("_ms").alias("_last"))
    )
    # Seen from a bucket: offset 1 is the bucket before it, -1 the one after.
    seen = spans.select(
        F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_offset"), "*"
    ).groupBy((F.col("_bucket") + F.col("_offset")).alias("_bucket")).agg(
        F.max(F.when(F.col("_offset") == 1, F.col("_last"))).alias("_before"),
        F.max(F.when(F.col("_offset") == 0, F.lit(True))).alias("_own"),
        F.min(F.when(F.col("_offset") == -1, F.col("_first"))).alias("_after"),
    )
    rows = df.withColumn("_ms", ms).withColumn("_bucket", bucket(F.col("_ms")))
    near = (
        F.coalesce("_own", F.lit(False))
        | F.coalesce(F.col("_ms") - F.col("_before") < reach, F.lit(False))
        | F.coalesce(F.col("_after") - F.col("_ms") < reach, F.lit(False))
    )
    return (
        rows.join(seen, "_bucket").where(near).drop("_bucket", "_ms", "_before", "_own", "_after")
    )


def by_keys(df: DataFrame, keys: DataFrame, key: str = "session") -> DataFrame:
    """Rows for a list of (pos, key); unknown keys go, a key named twice comes twice.

    ``list_pos`` holds the list's order, to sort by when showing the rows.
    """
    wanted = keys.select(F.col("pos").alias("list_pos"), F.col(key))
    return wanted.join(df, key)


def key_list(spark, keys: Sequence[str], key: str = "session") -> DataFrame:
    return spark.createDataFrame(list(enumerate(keys)), f"pos int, {key} string")


def _filter_paths(filters: DataFrame, key: str, value: str) -> DataFrame:
    """Lookup between path and id of filters; of equal keys the last counts."""
    table = filters.where(F.col("filter_paths").isNotNull()).select(
        F.array_join("filter_paths", "/").alias("path"), "id", "pos"
    )
    return table.groupBy(key).agg(F.max_by(value, "pos").alias(value))


def paths_to_ids(paths: DataFrame, filters: DataFrame) -> DataFrame:
    """Add the filter ``id`` to rows with a ``path``; unknown paths go."""
    return paths.join(_filter_paths(filters, "path", "id"), "path").where(F.col("id") != "")


def ids_to_paths(ids: DataFrame, filters: DataFrame) -> DataFrame:
    """Add the ``path`` to rows with a filter ``id``; unknown ids go."""
    return ids.join(_filter_paths(filters, "id", "path"), "id")


def only_in_narrative(df: DataFrame, members: DataFrame, key: str = "event_key") -> DataFrame:
    """Events that are in a story. ``members`` are its events, in any order: the steps, or
    the rows they are made from."""
    return df.join(members.select(key), key, "left_semi")


def flag_selected_locations(locations: DataFrame, selected: DataFrame) -> DataFrame:
    """Locations with ``is_selected``: a selected event has the same coordinates."""
    at = selected.select("latitude", "longitude").distinct().withColumn("is_selected", F.lit(True))
    return locations.join(at, ["latitude", "longitude"], "left").withColumn(
        "is_selected", F.coalesce("is_selected", F.lit(False))
    )


def selected_clusters(members: DataFrame, selected: DataFrame, key: str = "event_key") -> DataFrame:
    """Clusters (zoom, cell) that hold a location whose own id is a selected event's."""
    picked = selected.select(F.col(key).alias("location_id"), F.lit(True).alias("_picked")).distinct()
    cells = (
        members.join(picked, "location_id", "left")
        .groupBy("zoom", "cell_x", "cell_y")
        .agg(F.count(F.lit(1)).alias("point_count"), F.max("_picked").alias("_picked"))
    )
    return cells.where(F.col("_picked") & (F.col("point_count") > 1)).drop("_picked")
