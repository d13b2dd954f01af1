"""Finished sessions of a log that keeps coming, with lines that are late, repeated or out
of order.

Repeated lines go by ``dropDuplicatesWithinWatermark``. What is known about a session, a
part per event type, is keyed state: it is handed on when the watermark passes the
session's end, which is its last line once it was closed, and some idle time after it
otherwise; then the state is gone. A line that comes after that, but not too late for the
watermark, begins a new state whose part merges with what was handed on. So the merged
parts (``sessions_so_far`` and the others of ``streaming.sessions``) are those of a batch
over the distinct lines, and state only holds sessions that are open.
"""

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from eventscope import fixed_values as fixed
from eventscope.operators.sessions import RECORD_COLUMNS, clean_log, session_parts, stage_number

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Times are kept to the microsecond in the texts that parts travel as.
_WRITTEN = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}

# A part: (ms, pos) of the lines it keeps, and those lines' fields as JSON.
_STATE = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("stage_number", T.IntegerType()),
    *[
        field for name in ("first", "last", "connect", "closed") for field in (
            T.StructField(f"{name}_ms", T.LongType()), T.StructField(f"{name}_pos", T.LongType()),
            T.StructField(name, T.StringType()),
        )
    ],
])
_NAMES = [f.name for f in _STATE.fields]


def _kept(old: tuple | None, new: tuple | None, later: bool) -> tuple:
    """The earlier (or later) of two lines (ms, pos, fields)."""
    found = [line for line in (old, new) if line is not None and line[0] is not None]
    if not found:
        return (None, None, None)
    return (max if later else min)(found, key=lambda line: line[:2])


def merged(old: tuple | None, new: tuple) -> tuple:
    if old is None:
        return new
    out = [old[0] + new[0], min(old[1], new[1])]
    for at, later in ((2, False), (5, True), (8, False), (11, False)):
        out += _kept(old[at : at + 3], new[at : at + 3], later)
    return tuple(out)


class OpenSessions(StatefulProcessor):
    """A part per event type of each open session."""

    def __init__(self, keys: Sequence[str], closed: str, idle_ms: int):
        self.keys, self.closed, self.idle_ms = list(keys), closed, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        types = T.StructType([T.StructField("eventid", T.StringType())])
        self.parts = handle.getMapState("parts", types, _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, tuple] = {}
        for lines in rows:
            for line in lines.itertuples(index=False):
                at = (int(line.ms), int(line.pos))
                part = (1, int(line.stage_number)) + tuple(
                    value for name in ("first", "last", "connect", "closed")
                    for value in ((*at, getattr(line, name)) if isinstance(getattr(line, name), str) else (None,) * 3)
                )
                new[line.eventid] = merged(new.get(line.eventid), part)
        for eventid, part in new.items():
            old = tuple(self.parts.getValue((eventid,))) if self.parts.containsKey((eventid,)) else None
            self.parts.updateValue((eventid,), merged(old, part))
        last, ended = 0, False
        for (eventid,), part in self.parts.iterator():
            last, ended = max(last, part[_NAMES.index("last_ms")]), ended or eventid == self.closed
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + (0 if ended else self.idle_ms))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [(*key, eventid, *part) for (eventid,), part in self.parts.iterator()]
        self.parts.clear()
        yield pd.DataFrame(rows, columns=[*self.keys, "eventid", *_NAMES]).astype(
            {f"{n}_{x}": "Int64" for n in ("first", "last", "connect", "closed") for x in ("ms", "pos")}
        )

    def close(self) -> None:
        pass


def finished_parts(
    log: DataFrame,
    keys: Sequence[str] = ("session",),
    late: str = "2 hours",
    idle_seconds: int = 7200,
    identity: Sequence[str] | None = None,
    connect: str = fixed.CONNECT,
    closed: str = fixed.CLOSED,
    ladder=fixed.STAGES,
) -> DataFrame:
    """Parts of sessions, by event type, as they end: rows as of ``session_parts``.

    ``log`` is a stream with a whole number ``pos``. Lines are the same if they agree in
    ``identity`` (all columns, if not named), and are told apart as long as the watermark,
    ``late`` behind the latest line, has not passed them. Lines without an event id are no
    events, but let the watermark move on. Needs the RocksDB state store (``STATE_STORE``).
    """
    known = [c for c in log.columns if c not in RECORD_COLUMNS]
    timed = log.select(known).withColumn("_ts", F.try_to_timestamp(F.col("timestamp").cast("string")))
    distinct = timed.withWatermark("_ts", late).dropDuplicatesWithinWatermark(list(identity or known))
    lines = clean_log(distinct)
    # The columns that a batch would make of one line, so that both forms stay alike.
    shape = session_parts(lines, [*keys, "eventid"], connect, closed, ladder).schema
    one = {"connect": F.col("eventid") == connect, "closed": F.col("eventid") == closed}
    rows = lines.select(
        *keys, "eventid", "ms", F.col("pos").cast("long").alias("pos"), "_ts",
        stage_number(ladder=ladder).cast("int").alias("stage_number"),
        *[
            F.when(one.get(name, F.lit(True)), F.to_json(F.struct(*shape[name].dataType.names), _WRITTEN)).alias(name)
            for name in ("first", "last", "connect", "closed")
        ],
    )
    out = T.StructType([*[lines.schema[k] for k in keys], T.StructField("eventid", T.StringType()), *_STATE.fields])
    ended = rows.groupBy(*keys).transformWithStateInPandas(
        OpenSessions(keys, closed, idle_seconds * 1000), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )
    read = {name: F.from_json(name, shape[name].dataType.simpleString(), _WRITTEN) for name in one | {"first": 1, "last": 1}}
    made = read | {"stage_number": F.col("stage_number"), "event_count": F.col("n")}
    return ended.select(*keys, "eventid", *[
        made[f.name].alias(f.name) for f in shape.fields if f.name not in (*keys, "eventid")
    ])


def write_finished_parts(log: DataFrame, folder: str, checkpoint: str, **options):
    """The query that writes parts of ended sessions to ``folder``, each exactly once; the
    caller sets its trigger and starts it."""
    return (
        finished_parts(log, **options).writeStream.format("parquet").outputMode("append")
        .option("path", folder).option("checkpointLocation", checkpoint)
    )


def open_parts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of a stopped stream: a row per open session and event type."""
    return spark.read.format("statestore").option("path", checkpoint).option("operatorId", 0).option(
        "stateVarName", "parts"
    ).load()
