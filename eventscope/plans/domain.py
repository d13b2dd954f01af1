"""The linked domain: everything the queries run on."""

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventscope import fixed_values as fixed
from eventscope.operators import contracts, links
from eventscope.operators.once import computed
from eventscope.operators.sessions import log_to_events
from eventscope.sources.dimensions import read_dimension
from eventscope.sources.payloads import (
    read_event_lines, read_events, read_session_export, read_session_log,
)
from eventscope.sources.ranges import read_large_events, read_large_export

DIMENSIONS = ("associations", "sources", "sites", "regions", "shapes")
ASSOCIATION_FIELDS = ["id", "title", "desc", "mode", "filter_paths"]


@dataclass(frozen=True)
class Domain:
    events: DataFrame
    associations: DataFrame
    sources: DataFrame
    sites: DataFrame
    regions: DataFrame
    shapes: DataFrame
    rejects: DataFrame
    event_schema: DataFrame | None = None

    def with_features(self, **on: bool) -> "Domain":
        """Lookup tables that are switched off count as empty."""
        off = {name: getattr(self, name).limit(0) for name, used in on.items() if not used}
        return replace(self, **off)

    def rejects_summary(self) -> DataFrame:
        return contracts.rejects_summary(self.rejects)


def empty_dimension(spark: SparkSession, kind: str) -> DataFrame:
    contract = contracts.DIMENSIONS[kind]
    place = "source_id string" if kind == "sources" else "pos int"
    columns = [place, *[f"`{c}` string" for c in contract.text], *[f"`{c}` array<string>" for c in contract.lists]]
    return spark.createDataFrame([], ", ".join(columns))


def link_domain(
    events: DataFrame,
    dimensions: dict[str, DataFrame],
    custom_fields: Sequence[tuple[str, str]] = (),
    date_format: str = fixed.DATE_FORMAT,
    time_format: str = fixed.TIME_FORMAT,
    event_key: str = "pos",
) -> Domain:
    """Check all tables, keep the rejects, and put objects in place of ids.

    ``event_key`` names a column that tells events apart.
    """
    spark = events.sparkSession
    good, rejects = {}, []
    for kind in DIMENSIONS:
        table = dimensions.get(kind)
        if table is None:
            good[kind] = empty_dimension(spark, kind)
            continue
        good[kind], bad = contracts.validate_dimension(kind, table)
        rejects.append(bad)
    if "pos" in good["associations"].columns:
        repeated = contracts.duplicate_keys(good["associations"], "id", "pos")
        rejects.append(
            repeated.select(
                F.lit("associations").alias("table"), "id",
                F.lit("association is defined more than once; the first counts").alias("message"),
                F.to_json(F.struct(*repeated.columns)).alias("row_json"),
            )
        )
        good["associations"] = contracts.first_definitions(good["associations"])
    good["regions"] = contracts.parse_regions(good["regions"])
    shapes = contracts.first_definitions(good["shapes"]) if "pos" in good["shapes"].columns else good["shapes"]

    checked, bad = contracts.validate_events(events, custom_fields)
    rejects.append(bad)
    checked = checked.withColumn("event_key", F.col(event_key))
    # Shape and time are checked together, so a row that fails both says both.
    linked = contracts.normalise_coordinates(checked)
    linked = links.join_shape(linked, shapes)
    if "datetime" not in linked.columns:
        time = contracts.event_time("date", "time", date_format, time_format)
        linked = computed(linked, {"datetime": time})
    errors = contracts.messages([
        (links.unknown_shape(), "shape is not known"),
        (F.col("datetime").isNull(), "date or time cannot be read"),
    ])
    linked, bad = contracts.split_by_errors(linked, "events", errors)
    rejects.append(bad)
    linked = linked.withColumn("shape", F.col("shape_row")).drop("shape_row")
    linked = links.resolve_refs(
        linked, "associations", good["associations"], fields=ASSOCIATION_FIELDS
    )
    return Domain(events=linked, rejects=reduce(DataFrame.unionByName, rejects), **good)


def _session_events(log: DataFrame, keys: Sequence[str], **formats) -> DataFrame:
    """Events of a raw log, told apart by what their sessions are told apart by."""
    events = log_to_events(log, keys, **formats)
    nothing = F.lit(0).cast("long")
    return events.withColumns({
        "pos": F.struct(
            F.concat_ws("#", *keys).alias("file"), nothing.alias("block"), nothing.alias("place")
        ),
        "datetime": F.col("start_datetime"),
    }).drop("start_datetime", *[k for k in keys if k != "session"])


def load_domain(
    spark: SparkSession,
    events: Sequence[str] = (),
    dimensions: dict[str, Sequence[str]] | None = None,
    custom_fields: Sequence[tuple[str, str]] = (),
    date_format: str = fixed.DATE_FORMAT,
    time_format: str = fixed.TIME_FORMAT,
    event_lines: Sequence[str] = (),
    log_lines: Sequence[str] = (),
    large_events: Sequence[str] = (),
) -> Domain:
    """Read all payloads and link them.

    ``events`` are JSON documents, event arrays or session exports, told apart by their
    content; ``large_events`` are the same, read in ranges by many tasks. Bulk data comes as
    JSON Lines: ``event_lines`` and ``log_lines``.
    """
    formats = {"date_format": date_format, "time_format": time_format}
    time = contracts.event_time("date", "time", date_format, time_format)
    parts, tables, rejects = [], {}, []
    if events:
        plain = read_events(spark, events, custom_fields)
        export = read_session_export(spark, events)
        parts.append(computed(plain.rows, {"datetime": time}))
        parts.append(_session_events(export.rows, ["file", "session"], **formats))
        rejects.append(plain.rejects)
    if large_events:
        plain = read_large_events(spark, large_events, custom_fields)
        export = read_large_export(spark, large_events)
        parts.append(computed(plain.rows, {"datetime": time}))
        parts.append(_session_events(export.rows, ["file", "session"], **formats))
        # Both readers name the files that cannot be read.
        rejects.append(plain.rejects.unionByName(export.rejects).distinct())
    if event_lines:
        lines = read_event_lines(spark, event_lines, custom_fields)
        parts.append(computed(lines.rows, {"datetime": time}))
        rejects.append(lines.rejects)
    if log_lines:
        log = read_session_log(spark, log_lines)
        parts.append(_session_events(log.rows, ["session"], **formats))
        rejects.append(log.rejects)
    for kind, paths in (dimensions or {}).items():
        read = read_dimension(spark, kind, paths)
        tables[kind] = read.rows
        rejects.append(read.rejects)
    schema = tables.pop("event_schema", None)
    everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    domain = link_domain(everything, tables, custom_fields, date_format, time_format)
    return replace(
        domain, event_schema=schema, rejects=reduce(DataFrame.unionByName, [domain.rejects, *rejects])
    )
