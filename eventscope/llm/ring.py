"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` places; virtual nodes and keys fall on them by hash. Keys are taken
in ring order. A key belongs to the next virtual node clockwise; if that shard is full,
it goes on clockwise to the first shard that is not. With keys in ring order that is a
queue which is carried along the ring: each virtual node takes from its front what its
shard has room for. So the whole walk follows from a count per cell, and every virtual
node gets a stretch of consecutive keys. Only these counts meet in one task: ``CELLS``
times ``SALTS`` of them at most, however many rows there are.

A change of the shard count moves the keys of the arcs that change hands, and those that
overflow elsewhere because of it; more room (``spare``) makes the latter few.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventscope.llm.frames import saved

CELLS, VIRTUAL_NODES = 4096, 32
# Rows of a cell are ranked in so many parts, as one key may hold many rows.
SALTS = 16


def _virtual_nodes(spark, shards: int, virtual: int) -> DataFrame:
    """``arc`` from 0 clockwise, its ``shard`` and the cell where it ends."""
    nodes = spark.range(shards * virtual).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        # A shard's nodes stay where they are when others come.
        F.xxhash64(F.col("id") % shards, F.floor(F.col("id") / shards)).alias("hash"),
    ).withColumn("end", F.pmod("hash", F.lit(CELLS)))
    return nodes.select(
        (F.row_number().over(Window.orderBy("end", "hash")) - 1).cast("long").alias("arc"), "shard", "end"
    )


def _arcs_of_cells(nodes: DataFrame, total: int) -> DataFrame:
    """For each cell its ``arc``, and its ``turn`` on the walk, which starts with arc 0: the
    cells behind the last virtual node come first."""
    ends = nodes.groupBy("end").agg(F.count(F.lit(1)).alias("nodes"))
    earlier = F.sum("nodes").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    cells = nodes.sparkSession.range(CELLS).join(ends, F.col("id") == F.col("end"), "left")
    return cells.select("id", F.coalesce(earlier, F.lit(0)).alias("behind")).select(
        F.col("id").alias("cell"),
        (F.col("behind") % total).alias("arc"),
        F.when(F.col("behind") == total, F.col("id") - CELLS).otherwise(F.col("id")).alias("turn"),
    )


def _stretches(arcs: Column, shards: int, spare: float) -> Column:
    """The walk: for each virtual node that takes keys its shard, the rank of the first of
    them, how many, and how many the shard had before."""
    total = F.aggregate(arcs, F.lit(0).cast("long"), lambda sum_, a: sum_ + a["n"])
    shard_numbers = F.sequence(F.lit(0), F.lit(shards - 1))
    if spare:
        room = F.transform(shard_numbers, lambda i: F.ceil(total * (1 + spare) / shards).cast("long"))
    else:
        room = F.transform(
            shard_numbers, lambda i: F.floor(total / shards).cast("long") + F.when(i < total % shards, 1).otherwise(0)
        )
    empty = F.array().cast("array<struct<shard:int,first:bigint,n:bigint,slot:bigint>>")

    def step(state, a):
        queue = state["queue"] + a["n"]
        left = F.get(state["left"], a["shard"])
        take = F.least(queue, left)
        taken = F.struct(
            a["shard"].alias("shard"), state["rank"].alias("first"), take.alias("n"),
            (F.get(state["room"], a["shard"]) - left).alias("slot"),
        )
        return F.struct(
            state["room"].alias("room"),
            F.transform(state["left"], lambda x, i: F.when(i == a["shard"], x - take).otherwise(x)).alias("left"),
            (queue - take).alias("queue"),
            (state["rank"] + take).alias("rank"),
            F.when(take > 0, F.concat(state["out"], F.array(taken))).otherwise(state["out"]).alias("out"),
        )

    start = F.transform(F.array(room), lambda r: F.struct(
        r.alias("room"), r.alias("left"), F.lit(0).cast("long").alias("queue"),
        F.lit(0).cast("long").alias("rank"), empty.alias("out"),
    ))[0]
    # What is left after one round finds room in the second.
    again = F.transform(arcs, lambda a: F.struct(a["arc"].alias("arc"), a["shard"].alias("shard"), F.lit(0).cast("long").alias("n")))
    return F.aggregate(F.concat(arcs, again), start, step, lambda state: state["out"])


def assign(
    df: DataFrame, key: str, shards: int, *, virtual: int = VIRTUAL_NODES, spare: float = 0.0
) -> DataFrame:
    """``df`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    No shard takes more than its share of all rows times ``1 + spare``; with ``spare`` 0
    the counts differ by one at most. Null is a key like any other; rows with equal keys
    share a place on the ring. Columns of ``df`` with the new names are replaced. Saves
    ``df``, so select what is needed.
    """
    spark = df.sparkSession
    rows = saved(
        df.drop("shard", "slot")
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_cell", F.pmod(F.xxhash64(key), F.lit(CELLS)))
        .withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)))
    )
    nodes = _virtual_nodes(spark, shards, virtual)
    cells = _arcs_of_cells(nodes, shards * virtual)
    counts = rows.groupBy("_cell", "_salt").agg(F.count(F.lit(1)).alias("n"))
    in_turn = Window.orderBy("turn", "_salt")
    groups = saved(
        counts.join(cells, F.col("_cell") == F.col("cell")).select(
            "_cell", "_salt", "arc", "n", (F.sum("n").over(in_turn) - F.col("n")).alias("first")
        )
    )
    by_arc = nodes.join(groups.groupBy("arc").agg(F.sum("n").alias("n")), "arc", "left").agg(
        F.sort_array(F.collect_list(F.struct("arc", "shard", F.coalesce("n", F.lit(0)).alias("n")))).alias("arcs")
    )
    stretches = by_arc.select(F.inline(_stretches(F.col("arcs"), shards, spare)))

    # Groups and stretches both cut the ranks; between two cuts there is one of each.
    cuts = (
        groups.select("first", F.struct("_cell", "_salt", "first").alias("group"), F.lit(None).alias("stretch"))
        .unionByName(stretches.select("first", F.lit(None).alias("group"), F.struct("shard", "slot", "first").alias("stretch")))
        .groupBy("first").agg(F.max("group").alias("group"), F.max("stretch").alias("stretch"))
    )
    by_rank = Window.orderBy("first")
    parts = cuts.select(
        "first",
        F.last("group", ignorenulls=True).over(by_rank).alias("group"),
        F.last("stretch", ignorenulls=True).over(by_rank).alias("stretch"),
        F.lead("first").over(by_rank).alias("past"),
    ).select(
        F.col("group._cell").alias("cell"), F.col("group._salt").alias("salt"),
        (F.col("first") - F.col("group.first")).alias("from"),
        (F.col("past") - F.col("group.first")).alias("to"),
        F.col("stretch.shard").alias("shard"),
        (F.col("stretch.slot") + F.col("group.first") - F.col("stretch.first")).alias("base"),
    )
    place = F.row_number().over(Window.partitionBy("_cell", "_salt").orderBy("_row")) - 1
    return (
        rows.withColumn("_place", place)
        .join(
            parts,
            (F.col("_cell") == F.col("cell")) & (F.col("_salt") == F.col("salt")) & (F.col("_place") >= F.col("from"))
            & (F.col("to").isNull() | (F.col("_place") < F.col("to"))),
        )
        .select(
            *[F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")],
            parts["shard"], (F.col("base") + F.col("_place")).alias("slot"),
        )
    )
