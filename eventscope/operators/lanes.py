"""Lanes as a screen shows them: by start, each span in the lowest lane that is free.

The lane of a span follows from the lanes of the spans still open, so time is cut into
ranges, and what a range needs of all earlier ones is its state: the open spans' lanes and
ends. Where no span is open the state is empty, whatever came before. So every range that
holds such a place hands on its state at once; a range without one waits for the range
before. Rounds are one more than the longest row of such ranges, and one task in a round
handles one range.
"""

import heapq
from collections.abc import Sequence
from math import ceil
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType, IntegralType, TimestampNTZType, TimestampType

from eventscope.operators.ordering import range_sorted
from eventscope.operators.timeline import SPAN_ORDER
from eventscope.session import use_checkpoint_folder

# Spans of a range, about: they are in one task's memory, with one row each.
ROWS_PER_RANGE = 1 << 20


def _as_number(spans: DataFrame, name: str, missing: float) -> tuple[Column, str]:
    """A time as a number that sorts alike, ``missing`` where it is null."""
    kind, time = spans.schema[name].dataType, F.col(name)
    if isinstance(kind, DateType):
        time = F.unix_date(time)
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        time = F.unix_micros(time.cast("timestamp"))
    elif not isinstance(kind, IntegralType):
        return F.coalesce(time.cast("double"), F.lit(missing)), "double"
    bound = -(1 << 63) if missing < 0 else (1 << 63) - 1
    return F.coalesce(time.cast("long"), F.lit(bound)), "long"


def _rounds(rows: DataFrame) -> DataFrame:
    """Spans with their range ``_range`` (from 0, without gaps) and the round ``_round`` that
    lays them: 0 from the first place of their range at which no span is open, else the
    distance to the last range that has one."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    # Windows without a partition run over one row per range.
    reached = rows.groupBy("_part").agg(F.max("e").alias("_end")).select(
        "_part", (F.row_number().over(Window.orderBy("_part")) - 1).alias("_range"),
        F.max("_end").over(before).alias("_end_before"),
    )
    reach = F.greatest(F.max("e").over(above), F.col("_end_before"))
    marked = rows.join(F.broadcast(reached), "_part").withColumn(
        "_fresh", F.when(F.coalesce(F.col("s") > reach, F.lit(True)), F.col("_place"))
    )
    firsts = marked.groupBy("_range").agg(F.min("_fresh").alias("_first"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    known = F.max(F.when(F.col("_first").isNotNull(), F.col("_range"))).over(earlier)
    waits = firsts.select("_range", "_first", (F.col("_range") - known).alias("_wait"))
    return marked.join(F.broadcast(waits), "_range").select(
        "_range", "_place", "s", "e",
        F.when(F.coalesce(F.col("_place") >= F.col("_first"), F.lit(False)), 0)
        .otherwise(F.col("_wait")).alias("_round"),
    )


def _lay(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """Lanes of a range's spans, and in a last row without a place the state at its end."""
    columns = ["_range", "_place", "lane", "lanes", "ends"]
    if rows.empty:
        return pd.DataFrame(columns=columns)
    rows = rows.sort_values("_place")
    taken = [] if state.empty else list(zip(state["ends"].iloc[0], state["lanes"].iloc[0]))
    heapq.heapify(taken)
    used = max((int(lane) for _, lane in taken), default=-1) + 1
    free = sorted(set(range(used)) - {lane for _, lane in taken})
    lanes = []
    for start, end in zip(rows["s"].tolist(), rows["e"].tolist()):
        while taken and taken[0][0] < start:
            heapq.heappush(free, heapq.heappop(taken)[1])
        if free:
            lane = heapq.heappop(free)
        else:
            lane, used = used, used + 1
        heapq.heappush(taken, (end, lane))
        lanes.append(lane)
    here = rows["_range"].iloc[0]
    out = pd.DataFrame({"_range": here, "_place": rows["_place"].astype("Int64"), "lane": pd.array(lanes, "Int64")})
    out["lanes"] = out["ends"] = None
    last = pd.DataFrame({
        "_range": [here], "_place": pd.array([None], "Int64"), "lane": pd.array([None], "Int64"),
        "lanes": [[lane for _, lane in taken]], "ends": [[end for end, _ in taken]],
    })
    return pd.concat([out, last], ignore_index=True)[columns]


def lowest_lanes(
    spans: DataFrame,
    lane_size: int = 1,
    order: Sequence[str] = SPAN_ORDER,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Adds ``lane``, the lowest that is free when the span starts, and ``offset``, the lane
    times ``lane_size``. A lane is free once its last span ended before. There are as few
    lanes as can be.

    ``order`` must be total and begin with ``start``. A null start comes before all times, a
    null end never comes. The tables of the rounds stay in the checkpoint folder, in
    ``lanes-*``, as the result reads them.
    """
    spark = spans.sparkSession
    use_checkpoint_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/lanes-{uuid4().hex}"
    spans = spans.checkpoint()
    rows = range_sorted(spans, order, parts=max(1, ceil(spans.count() / rows_per_range)))
    (start, one), (end, other) = _as_number(spans, "start", float("-inf")), _as_number(spans, "end", float("inf"))
    number = "long" if one == other == "long" else "double"
    narrow = rows.select("_part", "_place", start.cast(number).alias("s"), end.cast(number).alias("e"))
    _rounds(narrow).write.partitionBy("_round").parquet(f"{folder}/spans")

    todo = spark.read.schema(f"_range int, _place long, s {number}, e {number}, _round int").parquet(f"{folder}/spans")
    schema = f"_range int, _place long, lane long, lanes array<long>, ends array<{number}>"
    state = spark.createDataFrame([], f"_range int, lanes array<long>, ends array<{number}>")
    last = todo.agg(F.max("_round")).first()[0]
    for turn in range(0 if last is None else last + 1):
        ranges = todo.where(F.col("_round") == turn).drop("_round").groupBy("_range")
        laid = ranges.cogroup(state.groupBy("_range")).applyInPandas(_lay, schema)
        laid.write.parquet(f"{folder}/laid/turn={turn}")
        done = spark.read.schema(schema).parquet(f"{folder}/laid/turn={turn}")
        state = done.where("_place IS NULL").select((F.col("_range") + 1).alias("_range"), "lanes", "ends")
    if last is None:
        lanes = spark.createDataFrame([], "_place long, lane long")
    else:
        lanes = spark.read.schema(schema).parquet(f"{folder}/laid").where("_place IS NOT NULL").select("_place", "lane")
    return rows.join(lanes, "_place").drop("_place", "_part").withColumn("offset", F.col("lane") * lane_size)
