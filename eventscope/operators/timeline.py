"""Density of the timeline, and the lanes of project spans."""

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from eventscope import fixed_values as fixed
from eventscope.operators.ordering import range_sorted
from eventscope.session import use_checkpoint_folder


def activity(events: DataFrame, minutes: int, track: str = "track", time: str = "datetime") -> DataFrame:
    """Events per track in windows of one of the timeline's widths."""
    return (
        events.groupBy(F.window(F.col(time).cast("timestamp"), f"{minutes} minutes").alias("w"), track)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("window_start"), track, "events")
    )


def activity_at(
    events: DataFrame, widths: Sequence[int], track: str = "track", time: str = "datetime"
) -> DataFrame:
    """Events per track at several window widths in minutes. Events are counted once, in
    windows that fit into all widths; the wider ones are added up from those."""
    fine = activity(events, math.gcd(*widths), track, time)
    minutes = F.explode(F.array(*[F.lit(w) for w in widths])).alias("minutes")
    width = F.col("minutes").cast("long") * 60_000
    start = F.floor(F.unix_millis("window_start") / width) * width
    return (
        fine.select("*", minutes)
        .groupBy("minutes", F.timestamp_millis(start).alias("window_start"), track)
        .agg(F.sum("events").alias("events"))
    )


def activity_by_label(events: DataFrame, label: str, **options) -> DataFrame:
    return activity(events, fixed.ZOOM_LEVELS[label], **options)


SPAN_ORDER = ["start", "first_key"]


def islands(spans: DataFrame, order: Sequence[str] = SPAN_ORDER) -> DataFrame:
    """Adds ``island``: spans of one island overlap in a chain, spans of two never do.

    Spans are sorted over all tasks by start. A span begins an island when all before it
    have ended; what earlier tasks hold comes from a table with one row per task.
    """
    rows = range_sorted(spans, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part").orderBy("_place")
    above = inside.rowsBetween(Window.unboundedPreceding, -1)

    # One row per task; the window over it has no more rows than that.
    ends = rows.groupBy("_part").agg(F.max("end").alias("_end"))
    reached = ends.select("_part", F.max("_end").over(before).alias("_end_before"))
    marked = (
        rows.join(F.broadcast(reached), "_part")
        .withColumn("_reach", F.greatest(F.max("end").over(above), F.col("_end_before")))
        .withColumn("_head", F.when(F.coalesce(F.col("start") > F.col("_reach"), F.lit(True)), F.col("_place")))
    )
    heads = marked.groupBy("_part").agg(F.max("_head").alias("_last_head"))
    carried = heads.select("_part", F.max("_last_head").over(before).alias("_head_before"))
    return (
        marked.join(F.broadcast(carried), "_part")
        .withColumn("island", F.coalesce(F.max("_head").over(inside), F.col("_head_before")))
        .drop("_place", "_part", "_reach", "_end_before", "_head", "_head_before")
    )


def _swept(spans: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Spans with their number ``_i`` in order, and their starts and ends in time: ``ended``
    spans before, ``load`` (spans open with this one, for starts) and ``used``, the greatest
    load before. An end at the time of a start counts after it.

    Both are sorted over all tasks; what earlier tasks hold comes from tables with one row
    per task.
    """
    rows = range_sorted(spans, order)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = rows.join(F.broadcast(bases), "_part").withColumn(
        "_i", F.col("_base") + F.col("_place") - F.col("_first")
    ).drop("_place", "_part", "_first", "_base")

    both = F.array(
        F.struct(F.col("start").alias("time"), F.lit(0).alias("is_end")),
        F.struct(F.col("end").alias("time"), F.lit(1).alias("is_end")),
    )
    times = range_sorted(numbered.select("_i", F.inline(both)), ["time", "is_end", "_i"])
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    ends = times.groupBy("_part").agg(F.sum("is_end").alias("_n"))
    bases = ends.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ended = times.join(F.broadcast(bases), "_part").withColumn(
        "ended", F.col("_base") + F.coalesce(F.sum("is_end").over(inside), F.lit(0))
    )
    loaded = ended.withColumn("load", F.when(F.col("is_end") == 0, F.col("_i") + 1 - F.col("ended")))
    tops = loaded.groupBy("_part").agg(F.max("load").alias("_top"))
    bases = tops.select("_part", F.coalesce(F.max("_top").over(before), F.lit(0)).alias("_used"))
    swept = loaded.join(F.broadcast(bases), "_part").select(
        "_i", "is_end", "ended", "load",
        F.greatest(F.col("_used"), F.coalesce(F.max("load").over(inside), F.lit(0))).alias("used"),
    )
    return numbered, swept


def _doubled(chains: DataFrame) -> DataFrame:
    """Chains whose links reach twice as far; a lane that is known goes along."""
    back = chains.select(
        F.col("_i").alias("_before"), F.col("_before").alias("_far"), F.col("lane").alias("_lane")
    )
    return chains.join(back, "_before").select(
        "_i", F.col("_far").alias("_before"), F.coalesce("lane", "_lane").alias("lane")
    )


def lanes_needed(spans: DataFrame, order: Sequence[str] = SPAN_ORDER) -> DataFrame:
    """One row: the greatest number of spans open at a time, and how many there are."""
    _, swept = _swept(spans, order)
    starts = swept.where("is_end = 0")
    return starts.agg(F.max("load").alias("lanes"), F.count(F.lit(1)).alias("spans"))


def assign_lanes(
    spans: DataFrame, lane_size: int = 1, order: Sequence[str] = SPAN_ORDER
) -> DataFrame:
    """Lay spans in lanes, as few as can be: by start, each in the lane that has been free
    for longest, or in a new one if all are taken. A lane is free once its last span ended
    before. ``offset`` is the lane times ``lane_size``.

    The k-th span that finds a free lane takes that of the k-th span to end, so a lane is a
    chain of matched ranks. Chains are followed by doubling: rounds grow with the logarithm
    of the longest, and each is saved.
    """
    use_checkpoint_folder(spans.sparkSession)
    numbered, swept = _swept(spans, order)
    starts, ends = swept.where("is_end = 0"), swept.where("is_end = 1")
    opens = F.col("load") > F.col("used")
    first = starts.where(opens).select("_i", F.col("_i").alias("_before"), F.col("used").alias("lane"))
    later = starts.where(~opens).select("_i", (F.col("_i") - F.col("used")).alias("_rank")).join(
        ends.select(F.col("_i").alias("_before"), F.col("ended").alias("_rank")), "_rank"
    )
    chains = first.unionByName(later.select("_i", "_before", F.lit(None).cast("long").alias("lane"))).checkpoint()
    while not chains.where(F.col("lane").isNull()).isEmpty():
        chains = _doubled(_doubled(chains)).checkpoint()
    return numbered.join(chains.select("_i", "lane"), "_i").drop("_i").withColumn(
        "offset", F.col("lane") * lane_size
    )
