"""Exact duplicates by distributed radix partitioning, most significant byte first.

All documents start in one bucket. A bucket that holds too large a share of all rows or
bytes is split by the next bytes of its texts, eight times as many at each step, until
its parts are small or the texts have ended. Those splits are counted for all large
buckets at once, one aggregation a step, with partial sums before the shuffle. A bucket
of texts that have ended holds equal texts only: its count and largest id come with the
same aggregation, so a group of copies of any size never meets in one task. The small
buckets are shuffled once, and each is split in memory in the same way until its groups
are single or ended. Texts are compared as bytes throughout, never by a digest.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

# A bucket is large with more than this share of a task's rows or bytes, and with more
# than this many at all.
SHARE, LEAST_ROWS, LEAST_BYTES = 0.25, 64, 1 << 20
FIRST_BYTES, WIDER = 16, 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def equal_groups(texts: list[bytes], start: int = 0) -> Iterator[list[int]]:
    """Indexes of equal texts, by radix from byte ``start`` on."""
    stack = [(list(range(len(texts))), start, FIRST_BYTES)]
    while stack:
        group, at, width = stack.pop()
        if len(group) == 1:
            yield group
            continue
        parts: dict[bytes, list[int]] = {}
        for i in group:
            parts.setdefault(texts[i][at : at + width], []).append(i)
        for chunk, part in parts.items():
            if len(chunk) < width:
                yield part
            else:
                stack.append((part, at + width, width * WIDER))


def _chunk(data: Column, start: int, width: int) -> Column:
    """Bytes of a text with A-Z lower-cased; only these bytes, as the text may be long."""
    letters = F.decode(F.substring(data, start + 1, width), "ISO-8859-1")
    return F.encode(F.translate(letters, UPPER, LOWER), "ISO-8859-1")


def _large_buckets(rows: DataFrame, tasks: int) -> list[DataFrame]:
    """For each step the buckets to split or, if their texts have ended, to close.

    A step has at most 2 / SHARE * tasks of them, whatever the data, since each holds
    more than SHARE / tasks of all rows or bytes.
    """
    spark = rows.sparkSession
    steps, start, width, nodes, limits = [], 0, FIRST_BYTES, 0, None
    here = rows.withColumn("_node", F.lit(0).cast("long"))
    while True:
        buckets = (
            here.withColumns({
                "_chunk": _chunk(F.col("_data"), start, width),
                "_ended": F.length("_data") < start + width,
            })
            .groupBy("_node", "_chunk", "_ended")
            .agg(
                F.count(F.lit(1)).alias("_n"),
                F.sum(F.length("_data").cast("long")).alias("_bytes"),
                F.max("_id").alias("_keep"),
            )
        )
        if limits is None:
            n, size = rows.agg(F.count(F.lit(1)), F.sum(F.length("_data").cast("long"))).first()
            limits = max(LEAST_ROWS, SHARE * n / tasks), max(LEAST_BYTES, SHARE * (size or 0) / tasks)
        large = buckets.where((F.col("_n") > limits[0]) | (F.col("_bytes") > limits[1])).collect()
        if not large:
            return steps
        # A single text may be large by its bytes; there is nothing to split then.
        named = [(nodes + 1 + k, *row) for k, row in enumerate(large) if row["_n"] > 1]
        nodes += len(large)
        if not named:
            return steps
        schema = T.StructType([T.StructField("_next", T.LongType()), *buckets.schema.fields])
        step = spark.createDataFrame(named, schema)
        steps.append(step)
        if all(row["_ended"] for row in large):
            return steps
        here = _descend(here, step, start, width).where(
            F.col("_next").isNotNull() & ~F.col("_ended")
        ).select(*rows.columns, F.col("_next").alias("_node"))
        start, width = start + width, width * WIDER


def _descend(here: DataFrame, step: DataFrame, start: int, width: int) -> DataFrame:
    """Rows with the large bucket that their next bytes lead to, if any. The step's table
    is broadcast; see ``_large_buckets`` for its bound."""
    at = here.withColumns({
        "_chunk": _chunk(F.col("_data"), start, width),
        "_ended": F.length("_data") < start + width,
    })
    return at.join(F.broadcast(step.drop("_bytes")), ["_node", "_chunk", "_ended"], "left")


def exact_groups(
    df: DataFrame, id: str = "doc_id", text: str = "text", columns: list[str] | None = None,
    digest: str | None = None,
) -> DataFrame:
    """The ``columns`` of ``df`` (all) with ``keep_id``, ``group_size`` and ``kept``; if named,
    also a ``digest`` column with the SHA-256 of the normalised text, in hexadecimal.

    Texts are equal if they are the same bytes after lower-casing A-Z; null counts as
    empty. Of equal texts one row with the largest id stays (a null id is smaller than
    any other); of rows with that id any one. Columns of ``df`` with the new names are
    replaced. Counts the large buckets while the plan is built, one aggregation a step.
    """
    spark = df.sparkSession
    new = ["keep_id", "group_size", "kept"] + [digest] * (digest is not None)
    columns = [c for c in columns or df.columns if c not in new]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    steps = _large_buckets(df.select(F.col(f"`{id}`").alias("_id"), data.alias("_data")), tasks)

    id_type = df.schema[id].dataType
    here = df.select(
        *[F.col(f"`{c}`") for c in columns],
        F.col(f"`{id}`").alias("_id"), data.alias("_data"), F.lit(0).cast("long").alias("_node"),
        F.lit(None).cast("long").alias("_size"), F.lit(None).cast(id_type).alias("_largest"),
        F.lit(None).cast("binary").alias("_place"),
    )
    carried = [*columns, "_id", "_data"]

    def place(chunk) -> Column:
        return F.concat(F.encode(F.col("_node").cast("string"), "utf-8"), F.lit(b"/"), chunk)

    start, width = 0, FIRST_BYTES
    for step in steps:
        found = _descend(here, step, start, width)
        closed = F.col("_next").isNotNull() & F.col("_ended")
        on = F.col("_next").isNotNull() & ~F.col("_ended")
        here = found.select(
            *[F.col(f"`{c}`") for c in carried],
            # A row that stopped at an earlier step has node -1 and stays as it was.
            F.when(on, F.col("_next")).otherwise(-1).cast("long").alias("_node"),
            F.when(closed, F.col("_n")).otherwise(F.col("_size")).alias("_size"),
            F.when(closed, F.col("_keep")).otherwise(F.col("_largest")).alias("_largest"),
            F.when((F.col("_node") >= 0) & ~on, place(F.col("_chunk"))).otherwise(F.col("_place")).alias("_place"),
        )
        start, width = start + width, width * WIDER
    # What went all the way down is placed by the bytes after the last step. Rows of a
    # closed bucket that lose are settled already and go anywhere.
    loses = F.col("_size").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_largest"))
    salt = F.pmod(F.xxhash64("_id"), F.lit(4 * tasks)).cast("string")
    here = here.withColumn("_loses", loses).withColumn(
        "_place",
        F.when(F.col("_loses"), F.concat(F.lit(b"-"), F.encode(salt, "utf-8"), F.lit(b"/"), F.col("_place")))
        .otherwise(F.coalesce("_place", place(_chunk(F.col("_data"), start, width)))),
    ).drop("_node")
    schema = T.StructType([f for c in columns for f in [df.schema[c]]] + [
        T.StructField("keep_id", id_type), T.StructField("group_size", T.LongType()),
        T.StructField("kept", T.BooleanType()),
    ] + ([T.StructField(digest, T.StringType())] if digest else []))
    met = here.repartition("_place").sortWithinPartitions("_place")
    return met.mapInArrow(_settle(schema, len(columns), digest is not None), schema)


def _settle(schema: T.StructType, given: int, with_digest: bool):
    """Splits each bucket of a sorted partition; holds one bucket at a time. The first
    ``given`` columns are passed through."""
    names = schema.fieldNames()
    kinds = [to_arrow_type(f.dataType) for f in schema.fields[given:]]

    def settle(bucket: pa.Table) -> pa.Table:
        ids, texts, sizes, largest, loses = (
            bucket.column(c).to_pylist() for c in ("_id", "_data", "_size", "_largest", "_loses")
        )
        texts = [t.lower() for t in texts]
        out = [None] * len(ids)
        for group in equal_groups(texts):
            lost, closed = loses[group[0]], sizes[group[0]]
            best = -1 if lost else max(group, key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0, -i))
            keep, size = (ids[best], len(group)) if closed is None else (largest[group[0]], closed)
            end = (hashlib.sha256(texts[group[0]]).hexdigest(),) if with_digest else ()
            for i in group:
                out[i] = (keep, size, i == best, *end)
        table = bucket.select(names[:given])
        for name, column, kind in zip(names[given:], zip(*out), kinds):
            table = table.append_column(name, pa.array(list(column), kind))
        return table

    def run(batches):
        waiting: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            places = rows.column("_place").to_pylist()
            cuts = [0] + [i for i in range(1, len(places)) if places[i] != places[i - 1]] + [len(places)]
            if waiting and waiting[-1].column("_place")[-1].as_py() != places[0]:
                yield from settle(pa.concat_tables(waiting)).to_batches()
                waiting = []
            for a, b in zip(cuts, cuts[1:]):
                waiting.append(rows.slice(a, b - a))
                if b < len(places):
                    yield from settle(pa.concat_tables(waiting)).to_batches()
                    waiting = []
        if waiting:
            yield from settle(pa.concat_tables(waiting)).to_batches()

    return run
