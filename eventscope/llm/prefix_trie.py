"""The trie of conversations: how many begin alike, and what storing shared turns once saves.

A node is a distinct sequence of first turns. It is named by a digest of that sequence, so
equal beginnings meet by one grouping. Depths are cut into bands of a fixed height. For
sums over subtrees a node is exploded to its ancestors within its own band only; then the
topmost nodes of the bands form a trie of their own, a band's height times flatter, whose
sums are found the same way, and a top's total goes to the ancestors in the band above.
So a conversation of d turns costs at most ``height`` rows a turn and log(d) rounds.

No conversation is ever in one task: turns are numbered by ranges that follow the data, and
gathered a band at a time.
"""

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from eventscope.llm.frames import saved
from eventscope.operators.ordering import range_sorted

# Depths of a band.
HEIGHT = 16
# Members are written out by ranges of ids of this width before they are hashed in order.
IDS = 4096
ROOT = "root"
EMPTY = hashlib.sha256().hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


def _digest(*parts: Column) -> Column:
    """32 hex digits for a sequence of strings."""
    measured = [p for part in parts for p in (F.length(part).cast("string"), F.lit(":"), part)]
    return F.left(F.sha2(F.concat(*measured).cast("binary"), 256), F.lit(32))


def numbered_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows (conv_id, pos, step, words): the turns of each conversation, counted from 1 in the
    order of ``turn``, null first, a digest of role and text, and the words of the text.

    Null role and text count as empty. Turns with one number come by role, then by the first
    64 characters of the text, then by digest; rows that are alike are turns of their own.
    Rows without a conversation belong to none and are left out. Other columns are not read.
    """
    role_, text_ = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    rows = turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), role_.alias("role"),
        F.left(text_, F.lit(64)).alias("start"), _digest(role_, text_).alias("step"),
        F.regexp_count(text_, F.lit(WORD)).cast("long").alias("words"),
    )
    placed = range_sorted(rows, ["conv_id", "turn", "role", "start", "step"])
    # One row per conversation and task that has turns of it.
    parts = placed.groupBy("conv_id", "_part").agg(F.min("_place").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return placed.join(parts.drop("n"), ["conv_id", "_part"]).select(
        "conv_id", (F.col("before") + F.col("_place") - F.col("first") + 1).alias("pos"), "step", "words"
    )


def with_shared_start(steps: DataFrame, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the start of their family's first one, and their turns.

    Conversation c, whose crc32 modulo ``most`` is h, begins with the first h turns of
    c - c % ``family`` and goes on with its own turns after its first h. Rows (conv_id) of
    all conversations, those left without a turn included, and rows as of ``steps``.
    """
    steps = saved(steps)
    share = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    convs = steps.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base = (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    wanted = convs.select("conv_id", base, share.alias("share"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("has"))
    wanted = wanted.join(sizes, "base", "left").withColumn(
        "lent", F.least("share", F.coalesce("has", F.lit(0)))
    )
    heads = steps.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    lent = wanted.join(heads, "base").where("pos <= share").select("conv_id", "pos", "step", "words")
    own = steps.join(wanted, "conv_id").where("pos > share").select(
        "conv_id", (F.col("pos") - F.col("share") + F.col("lent")).alias("pos"), "step", "words"
    )
    return convs.select("conv_id"), lent.unionByName(own)


def _bands(rows: DataFrame, height: int, *columns: str) -> DataFrame:
    """Rows (conv_id, band, and an array of each column by ``pos``, which counts from 0)."""
    gathered = F.sort_array(F.collect_list(F.struct("pos", *columns)))
    return rows.groupBy("conv_id", F.floor(F.col("pos") / height).alias("band")).agg(
        gathered.alias("_rows")
    ).select("conv_id", "band", *[F.col(f"_rows.{c}").alias(c) for c in columns])


def _prefix_keys(rows: DataFrame, depth: int, height: int, *columns: str) -> DataFrame:
    """Bands of ``rows`` (conv_id, pos from 0, step), with ``keys``: digests of all steps so far.

    What came before a band is known by the digests of the bands before it, which are a
    sequence ``height`` times shorter.
    """
    bands = _bands(rows, height, "step", *columns)
    if depth <= height:
        bands = bands.withColumn("start", F.lit(ROOT))
    else:
        bands = saved(bands)
        whole = bands.select("conv_id", F.col("band").alias("pos"), _digest(F.array_join("step", "")).alias("step"))
        above = _prefix_keys(whole, -(-depth // height), height)
        # The key of all bands up to one is the start of the next.
        starts = above.select("conv_id", F.posexplode("keys").alias("at", "start"), "band").select(
            "conv_id", (F.col("band") * height + F.col("at") + 1).alias("band"), "start"
        )
        bands = bands.join(starts, ["conv_id", "band"], "left").fillna(ROOT, ["start"])
    folded = F.aggregate(
        "step", F.array("start"), lambda keys, step: F.concat(keys, F.array(_digest(F.element_at(keys, -1), step)))
    )
    return bands.withColumn("keys", F.slice(folded, 2, F.size("step"))).drop("step")


def _with_paths(bands: DataFrame, depth: int, height: int, *columns: str) -> DataFrame:
    """A row per conversation and depth: ``key``, ``path`` (the keys from the top of the band
    down to it) and ``above`` (the key over the band's top; null in the first band)."""
    if depth > height:
        last = bands.select(
            "conv_id", (F.col("band") + 1).alias("band"), F.element_at("keys", -1).alias("above")
        )
        bands = bands.join(last, ["conv_id", "band"], "left")
    else:
        bands = bands.withColumn("above", F.lit(None).cast("string"))
    at = F.col("at")
    return bands.select("*", F.posexplode("keys").alias("at", "key")).select(
        "conv_id", (F.col("band") * height + at).alias("pos"), "key", "above",
        F.slice("keys", 1, at + 1).alias("path"), *[F.col(c)[at].alias(c) for c in columns],
    )


def _rollup(nodes: DataFrame, sequences: DataFrame, depth: int, height: int, sums: list[str]) -> DataFrame:
    """Rows (key, sums over the subtree). ``nodes``: a row per key with ``path`` and ``above``;
    ``sequences``: the keys of each conversation by ``pos``."""

    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(*[F.sum(s).alias(s) for s in sums])

    def to_ancestors(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode("path").alias("key"), *sums)

    inside = added(to_ancestors(nodes))
    if depth <= height:
        return inside
    inside = saved(inside)
    tops = saved(sequences.where(F.col("pos") % height == 0).select(
        "conv_id", F.floor(F.col("pos") / height).alias("pos"), "key"
    ))
    shallower = -(-depth // height)
    in_tops = _with_paths(_bands(tops, height, "key").withColumnRenamed("key", "keys"), shallower, height)
    top_nodes = in_tops.groupBy("key").agg(F.first("path").alias("path"), F.first("above").alias("above"))
    totals = _rollup(saved(top_nodes.join(inside, "key")), tops, shallower, height, sums)
    places = nodes.select("key", "path", "above")
    carried = added(
        totals.join(places.where("above IS NOT NULL AND size(path) = 1"), "key").drop("key")
        .withColumnRenamed("above", "key")
    )
    return added(inside.unionByName(to_ancestors(carried.join(places, "key"))))


def _ends_sha256(ends: DataFrame) -> DataFrame:
    """Rows (key, ends_sha256) of rows (key, conv_id): the hash of the ids in ascending order.

    A hash is made in order, so one task passes over a node's ids; it gets them as text, a
    row per range of ids, and holds one batch of rows.
    """
    texts = ends.groupBy("key", F.floor(F.col("conv_id") / IDS).alias("range")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids")
    )

    def run(batches):
        key, state = None, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([key]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"]
            )

        for batch in batches:
            for next_key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if next_key == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    yield row()
                key, state = next_key, hashlib.sha256(ids.encode())
        if key is not None:
            yield row()

    in_order = texts.repartition("key").sortWithinPartitions("key", "range")
    return in_order.select("key", "ids").mapInArrow(run, "key string, ends_sha256 string")


def trie(convs: DataFrame, steps: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row per node of the trie of conversations.

    ``convs`` has a row (conv_id) per conversation, ``steps`` rows (conv_id, pos from 1 without
    gaps, step, words). Columns: conv_id, the smallest member; depth; parent_conv_id (null for
    the root); n_convs; n_children; n_leaves; saved_tokens; ends_sha256. Without any
    conversation there is no node, not even a root.
    """
    steps = saved(steps.select("conv_id", (F.col("pos") - 1).alias("pos"), "step", "words"))
    depth = (steps.agg(F.max("pos")).first()[0] or 0) + 1
    bands = _prefix_keys(steps, depth, height, "words").withColumnRenamed("keys", "key")
    bands = saved(bands.withColumnRenamed("key", "keys").drop("start"))
    sequences = _with_paths(bands, depth, height, "words")
    parent = F.when(F.size("path") > 1, F.get("path", F.size("path") - 2)).otherwise(F.coalesce("above", F.lit(ROOT)))
    # All but the first two are alike for a key.
    nodes = saved(sequences.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        (F.first("pos") + 1).alias("depth"), F.first("words").alias("words"),
        F.first("path").alias("path"), F.first("above").alias("above"),
    ).withColumn("parent", parent))

    # A conversation's last band ends with its last node.
    last = bands.groupBy("conv_id").agg(F.max(F.struct("band", F.element_at("keys", -1).alias("key"))).alias("last"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("last.key", F.lit(ROOT)).alias("key"))
    hashes = _ends_sha256(ends)

    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = saved(nodes.join(children, "key", "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)),
        "n_leaves": F.col("n_children").isNull().cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("words"),
    }))
    sums = ["n_leaves", "saved_tokens"]
    keys = _with_paths(bands, depth, height).select("conv_id", "pos", "key")
    totals = _rollup(counted.select("key", "path", "above", *sums), keys, depth, height, sums)

    below = counted.agg(
        F.count_if(F.col("depth") == 1).alias("n_children"), *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sums]
    )
    members = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    # Both have one row.
    root = saved(members.join(below, F.lit(True)).where("n_convs > 0").select(
        F.lit(ROOT).alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens",
    ))
    names = root.columns
    rest = counted.drop(*sums).join(totals, "key")
    over = counted.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    lower = rest.where("depth > 1").join(over, "parent").select(*names)
    # The root is the parent of all nodes of the first depth: its one row is sent along.
    of_root = root.select(F.col("conv_id").alias("parent_conv_id"))
    first = rest.where("depth = 1").join(F.broadcast(of_root), F.lit(True)).select(*names)
    parts = [root, first] + ([lower] if depth > 1 else [])
    return reduce(DataFrame.unionByName, parts).join(hashes, "key", "left").fillna(EMPTY, ["ends_sha256"]).drop("key")
