"""Sessions of a log that keeps coming.

Each micro-batch writes what it says about its sessions (``session_parts``), by event type,
to a folder of its own; the sessions, groups and events so far come from the merged parts. Parts are minima, maxima and sums, so
they merge in any order, late lines included, no state grows in the stream, and a batch
that is run again after a failure overwrites its own folder.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventscope import fixed_values as fixed
from eventscope.operators.sessions import (
    clean_log, groups_from_parts, merge_parts, parts_with_types, session_parts, sessions_from_parts,
    sessions_to_events,
)


def read_log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines as they arrive; ``schema`` must hold the log's columns and ``pos``."""
    return spark.readStream.schema(schema).json(path)


def write_parts(
    log: DataFrame,
    folder: str,
    checkpoint: str,
    keys: Sequence[str] = ("session",),
    connect: str = fixed.CONNECT,
    closed: str = fixed.CLOSED,
    ladder=fixed.STAGES,
):
    """The query that turns a log stream into parts; the caller sets its trigger and starts it."""

    def write(batch: DataFrame, number: int) -> None:
        parts = session_parts(clean_log(batch), [*keys, "eventid"], connect, closed, ladder)
        parts.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def parts_so_far(spark: SparkSession, folder: str, keys: Sequence[str] = ("session",)) -> DataFrame:
    """One row per session and event type."""
    return merge_parts(spark.read.parquet(folder).drop("batch"), [*keys, "eventid"])


def sessions_so_far(
    spark: SparkSession, folder: str, keys: Sequence[str] = ("session",), ladder=fixed.STAGES,
    event_order: Sequence[str] = fixed.EVENT_ORDER,
) -> DataFrame:
    """Sessions with their event types in display order."""
    return sessions_from_parts(
        parts_with_types(parts_so_far(spark, folder, keys), keys, event_order), keys, ladder
    )


def groups_so_far(
    spark: SparkSession, folder: str, keys: Sequence[str] = ("session",),
    event_order: Sequence[str] = fixed.EVENT_ORDER,
) -> DataFrame:
    return groups_from_parts(parts_so_far(spark, folder, keys), keys, event_order)


def events_so_far(
    spark: SparkSession, folder: str, keys: Sequence[str] = ("session",), ladder=fixed.STAGES, **options
) -> DataFrame:
    return sessions_to_events(sessions_so_far(spark, folder, keys, ladder), **options)


def compact_parts(spark: SparkSession, folder: str, target: str, keys: Sequence[str] = ("session",)) -> None:
    """Many small batches as one row per session and type, in a new folder. Stop the stream
    before, and let it go on writing to ``target``."""
    parts_so_far(spark, folder, keys).write.mode("overwrite").parquet(f"{target}/batch=-1")
