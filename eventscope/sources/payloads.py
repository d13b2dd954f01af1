"""Event payloads: JSON arrays of events, session exports, and JSON Lines logs.

A payload that is one JSON document is read by one task, whatever engine reads it. For
bulk data use the line forms: there every line is a row and files split freely.

Nothing that can be read stops the load: a file that is not there or not JSON becomes a
row of ``rejects``.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from eventscope.operators.contracts import (
    EVENT, REJECTS_SCHEMA, Contract, fields_of, type_errors, with_custom_fields,
)
from eventscope.operators.once import computed

# Envelope and per-type fields of a raw log event that the session operators use.
LOG_FIELDS = [
    "eventid", "timestamp", "src_ip", "src_port", "dst_ip", "dst_port",
    "sensor", "uuid", "protocol", "duration",
]

_RECORD = "struct<src_ip string, location string, latitude string, longitude string, events array<string>>"


@dataclass(frozen=True)
class Read:
    """Rows that were read, and what could not be."""

    rows: DataFrame
    rejects: DataFrame


def read_text(spark: SparkSession, paths: Sequence[str], **options) -> tuple[DataFrame | None, list[str]]:
    """The files as text, and the paths that name nothing."""
    paths = list(paths)
    try:
        return (spark.read.text(paths, **options) if paths else None), []
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    if len(paths) == 1:
        return None, paths
    alone = {path: read_text(spark, [path], **options)[0] for path in paths}
    found = [path for path, text in alone.items() if text is not None]
    return (spark.read.text(found, **options) if found else None), [p for p in paths if p not in found]


def missing_rejects(spark: SparkSession, table: str, paths: Sequence[str]) -> DataFrame:
    rows = [(table, path, f"{table} could not be read", None) for path in paths]
    return spark.createDataFrame(rows, REJECTS_SCHEMA)


def read_documents(spark: SparkSession, paths: Sequence[str], table: str = "events") -> Read:
    """Whole JSON documents as (file, text, doc); unreadable ones are rejects."""
    files, missing = read_text(spark, paths, wholetext=True)
    rejects = missing_rejects(spark, table, missing)
    if files is None:
        return Read(spark.createDataFrame([], "file string, text string, doc variant"), rejects)
    docs = files.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("value").alias("text"),
        F.try_parse_json("value").alias("doc"),
    )
    broken = docs.where(F.col("doc").isNull()).select(
        F.lit(table).alias("table"), F.col("file").alias("id"),
        F.lit(f"{table} could not be read").alias("message"), F.col("text").alias("row_json"),
    )
    return Read(docs.where(F.col("doc").isNotNull()), rejects.unionByName(broken))


def is_session_export(doc="doc"):
    """A JSON object in which some value holds a list of ``events``."""
    records = F.map_values(F.try_variant_get(doc, "$", "map<string,variant>"))
    kinds = F.transform(records, lambda r: F.schema_of_variant(F.try_variant_get(r, "$.events", "variant")))
    has_events = F.exists(kinds, lambda k: F.coalesce(k.startswith("ARRAY"), F.lit(False)))
    return F.coalesce(has_events, F.lit(False))


def classify_payloads(docs: DataFrame) -> DataFrame:
    return docs.withColumn("is_session_export", is_session_export())


def events_of(objects: DataFrame, custom_fields: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Rows with a JSON object ``event`` as typed events. Fields outside the contract go to
    ``extra``; values of the wrong type are noted in ``type_errors``."""
    contract: Contract = with_custom_fields(EVENT, custom_fields)
    others = F.map_filter(
        F.try_variant_get("event", "$", "map<string,variant>"),
        lambda name, _: ~name.isin(contract.columns),
    )
    extra = F.transform_values(
        others, lambda _, v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    )
    return computed(objects, {
        **fields_of(contract, F.col("event")),
        "extra": extra,
        "type_errors": type_errors(contract, F.col("event")),
    }).drop("event")


def event_objects(docs: DataFrame) -> DataFrame:
    """Elements of documents that are plain arrays, with their place."""
    items = F.try_variant_get("doc", "$", "array<variant>")
    return docs.select("file", F.posexplode(items).alias("place", "event")).select(
        F.struct("file", F.lit(0).cast("long").alias("block"), F.col("place").cast("long").alias("place")).alias("pos"),
        "event",
    )


def line_position():
    """Place of a line in its file, sortable: rows rise within a block, blocks in a file.

    Good for order and within a query. How files are cut into blocks is up to the cluster,
    so write the events out before matching results of several queries by it.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )


def read_event_lines(spark: SparkSession, paths: Sequence[str], custom_fields: Sequence[tuple[str, str]] = ()) -> Read:
    """Events in bulk: one JSON object per line."""
    files, missing = read_text(spark, paths)
    rejects = missing_rejects(spark, "events", missing)
    if files is None:
        empty = spark.createDataFrame([], "pos struct<file string, block bigint, place bigint>, event variant")
        return Read(events_of(empty, custom_fields), rejects)
    lines = files.where(F.trim("value") != "").select(
        line_position().alias("pos"), F.col("value").alias("text"),
        F.try_parse_json("value").alias("event"),
    )
    good, bad = _split_lines(lines, "event", "events")
    return Read(events_of(good.drop("text"), custom_fields), rejects.unionByName(bad))


def _split_lines(lines: DataFrame, column: str, table: str) -> tuple[DataFrame, DataFrame]:
    is_object = F.coalesce(F.schema_of_variant(column).startswith("OBJECT"), F.lit(False))
    bad = lines.where(~is_object).select(
        F.lit(table).alias("table"), F.col("pos.file").alias("id"),
        F.lit("line is not a JSON object").alias("message"), F.col("text").alias("row_json"),
    )
    return lines.where(is_object), bad


def read_events(spark: SparkSession, paths: Sequence[str], custom_fields: Sequence[tuple[str, str]] = ()) -> Read:
    """Events of a list of payloads, one after the other; session exports are skipped here
    (``read_session_export``)."""
    docs = read_documents(spark, paths)
    plain = docs.rows.where(~is_session_export())
    return Read(events_of(event_objects(plain), custom_fields), docs.rejects)


def export_log(docs: DataFrame) -> DataFrame:
    """Session exports as one row per raw log event, in the order of the log."""
    sessions = docs.select(
        "file", F.explode(F.from_json("text", f"map<string,{_RECORD}>")).alias("session", "record")
    )
    events = sessions.select(
        "file", "session", "record", F.posexplode("record.events").alias("pos", "raw")
    )
    return _log_columns(
        events.select(
            "file",
            "session",
            F.col("pos").cast("long").alias("pos"),
            F.col("record.src_ip").alias("record_src_ip"),
            *[F.col(f"record.{c}").alias(c) for c in ("location", "latitude", "longitude")],
            "raw",
        )
    )


def read_session_export(spark: SparkSession, paths: Sequence[str]) -> Read:
    """Raw log of session exports. A session is one record of one file, so group it by
    (file, session)."""
    docs = read_documents(spark, paths)
    return Read(export_log(docs.rows.where(is_session_export())), docs.rejects)


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Rows of (pos, raw), with one JSON log event in ``raw``, as a raw log."""
    return _log_columns(lines)


def _log_columns(log: DataFrame) -> DataFrame:
    """The fields of ``raw`` as columns; values keep their text. One parse per line."""
    found = [f for f in ("session", *LOG_FIELDS) if f not in log.columns]
    schema = "struct<" + ", ".join(f"{f} string" for f in found) + ">"
    return log.select("*", F.inline(F.array(F.from_json("raw", schema))))


def read_session_log(spark: SparkSession, paths: Sequence[str]) -> Read:
    """Raw log in bulk: one JSON log event per line."""
    files, missing = read_text(spark, paths)
    rejects = missing_rejects(spark, "log", missing)
    if files is None:
        empty = spark.createDataFrame([], "pos struct<file string, block bigint, place bigint>, raw string")
        return Read(parse_log_lines(empty), rejects)
    lines = files.where(F.trim("value") != "").select(
        line_position().alias("pos"), F.col("value").alias("raw")
    )
    checked = lines.withColumns({"_doc": F.try_parse_json("raw"), "text": F.col("raw")})
    good, bad = _split_lines(checked, "_doc", "log")
    return Read(parse_log_lines(good.drop("_doc", "text")), rejects.unionByName(bad))
