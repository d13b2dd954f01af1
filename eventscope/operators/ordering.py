"""Order within a group, for groups of any size.

A window sorts a whole group in one task. That is the plan for groups that are known to
be small. Else the caller names a bucket, a coarser step of the order such as the day:
rows are numbered within buckets, and a table with one row per group and bucket holds
what came before and what the neighbouring buckets end with. A group then takes as many
tasks as it has buckets. All of it is one plan; nothing is counted to choose it.

Where the data may crowd into one such step, the caller names a number that the order
follows (``along``) instead. A sketch of its quantiles, merged from all tasks, says where
a group is to be cut, so that it takes as many buckets as its size asks; small groups stay
whole. Only rows that are equal in that number cannot be told apart.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventscope.session import use_checkpoint_folder

# Rows of a group that one task numbers, about, where the caller says what to cut along; how
# many buckets a group may have, and the size of the sketch that finds them.
ROWS_PER_BUCKET = 1 << 20
MOST_BUCKETS, SKETCH_SIZE = 1000, 2000


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    index: str = "idx",
    total: str | None = None,
    following: dict[str, Column] | None = None,
    preceding: dict[str, Column] | None = None,
    bucket: Column | None = None,
    along: Column | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add the row's place in its group (from 0), the group's size, and values of the
    rows after and before it.

    ``keys`` may be empty: then the whole table is one group. ``order`` must be total
    within a group, or equal rows are numbered either way round. ``bucket``, or the whole
    number ``along``, must not fall while the order rises, and be null where the first column
    of the order is. With ``along``, a group of more than ``rows_per_bucket`` rows is cut into
    buckets of about so many, or into ``MOST_BUCKETS`` larger ones.
    """
    following, preceding = following or {}, preceding or {}
    plain = not keys
    if plain:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    keys, order = list(keys), list(order)
    if along is not None:
        out = _by_bucket(
            _with_borders(df, keys, along, rows_per_bucket), keys, order, index, total, following, preceding,
            F.when(along.isNotNull(), F.coalesce(F.size(F.filter("_borders", lambda b: b <= along)), F.lit(0))),
        ).drop("_borders")
    elif bucket is None:
        out = _by_window(df, keys, order, index, total, following, preceding)
    else:
        out = _by_bucket(df, keys, order, index, total, following, preceding, bucket)
    return out.drop("_all") if plain else out


def _with_borders(df: DataFrame, keys: list[str], along: Column, rows_per_bucket: int) -> DataFrame:
    """``df`` with ``_borders``, the values of ``along`` at which the buckets of a large group
    begin: quantiles of a mergeable sketch. Null for the other groups."""
    sizes = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.kll_sketch_agg_bigint(along.cast("long"), F.lit(SKETCH_SIZE)).alias("_sketch"),
    ).where(F.col("_n") > rows_per_bucket)
    # Without values there is nothing to cut by.
    known = sizes.where(F.kll_sketch_get_n_bigint("_sketch") > 0)
    shares = F.array(*[F.lit(i / MOST_BUCKETS) for i in range(1, MOST_BUCKETS)])
    parts = F.least(F.ceil(F.col("_n") / rows_per_bucket), F.lit(MOST_BUCKETS)).cast("int")
    cuts = known.withColumn("_cuts", F.kll_sketch_get_quantile_bigint("_sketch", shares))
    chosen = F.transform(
        F.sequence(F.lit(1), parts - 1),
        lambda i: F.get("_cuts", F.floor(i * MOST_BUCKETS / parts).cast("int") - 1),
    )
    borders = cuts.select(*keys, F.array_sort(F.array_distinct(chosen)).alias("_borders"))
    # A row per large group, which there are few of.
    here = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys]
    return df.alias("l").join(borders.alias("r"), here, "left").select("l.*", "r._borders")


def _by_window(df, keys, order, index, total, following, preceding):
    group = Window.partitionBy(*keys)
    in_order = group.orderBy(*order)
    columns = {index: F.row_number().over(in_order).cast("long") - 1}
    if total:
        columns[total] = F.count(F.lit(1)).over(group)
    columns |= {name: F.lead(c).over(in_order) for name, c in following.items()}
    columns |= {name: F.lag(c).over(in_order) for name, c in preceding.items()}
    return df.withColumns(columns)


def _by_bucket(df, keys, order, index, total, following, preceding, bucket):
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket")
    in_order = inside.orderBy(*order)
    columns = {"_place": F.row_number().over(in_order).cast("long"), "_size": F.count(F.lit(1)).over(inside)}
    columns |= {f"_next_{name}": F.lead(c).over(in_order) for name, c in following.items()}
    columns |= {f"_last_{name}": F.lag(c).over(in_order) for name, c in preceding.items()}
    placed = rows.withColumns(columns)

    def values(wanted):
        return F.struct(F.lit(0).alias("_"), *[c.alias(name) for name, c in wanted.items()])

    # One row per group and bucket.
    edges = rows.groupBy(*keys, "_bucket").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(values(following), F.struct(*order)).alias("_first"),
        F.max_by(values(preceding), F.struct(*order)).alias("_end"),
    )
    group = Window.partitionBy(*keys)
    across = group.orderBy("_bucket")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        *keys, "_bucket",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("_total"),
        F.lead("_first").over(across).alias("_after"),
        F.lag("_end").over(across).alias("_back"),
    )
    here = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"e.`{k}`")) for k in [*keys, "_bucket"]]
    joined = placed.alias("r").join(edges.alias("e"), here)
    out = {index: F.col("_before") + F.col("_place") - 1}
    if total:
        out[total] = F.col("_total")
    out |= {
        name: F.when(F.col("_place") == F.col("_size"), F.col("_after")[name]).otherwise(F.col(f"_next_{name}"))
        for name in following
    }
    out |= {
        name: F.when(F.col("_place") == 1, F.col("_back")[name]).otherwise(F.col(f"_last_{name}"))
        for name in preceding
    }
    kept = [c for c in df.columns if c not in out]
    return joined.select(*[F.col(f"r.`{c}`") for c in kept], *[c.alias(name) for name, c in out.items()])


def range_sorted(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Rows spread over tasks by ``order`` and sorted there, with ``_place`` rising in
    that order and ``_part`` the task; ``parts`` tasks, or as many as a shuffle has.

    The checkpoint keeps the split as it is: split points are sampled, and a second run
    would draw other ones.
    """
    use_checkpoint_folder(df.sparkSession)
    place = F.monotonically_increasing_id()
    return (
        df.repartitionByRange(*([parts] if parts else []), *order)
        .sortWithinPartitions(*order)
        .withColumn("_place", place)
        .withColumn("_part", F.shiftright("_place", 33))
        .checkpoint()
    )
