import random

import pytest
from pyspark.sql import functions as F

from eventscope.operators.ordering import numbered


def rows_with_hot_key(n=600):
    """A third of the rows in one key, and half of those at one time."""
    random.seed(7)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{random.randrange(40)}"
        time = 5 if key == "hot" and i % 2 == 0 else random.randrange(100)
        rows.append((key, time, i, f"v{i}"))
    return rows


def expected(rows, keyed=True):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0] if keyed else 0, []).append(row)
    out = {}
    for group in groups.values():
        for i, row in enumerate(group):
            after = group[i + 1][3] if i + 1 < len(group) else None
            before = group[i - 1][3] if i else None
            out[row[2]] = (i, len(group), after, before)
    return out


def found(df):
    return {r.pos: (r.idx, r.total, r.after, r.before) for r in df.collect()}


@pytest.mark.parametrize("width", [1, 7, 1000, None])
@pytest.mark.parametrize("keyed", [True, False])
def test_same_numbers_by_window_and_by_bucket(spark, many_parts, width, keyed):
    rows = rows_with_hot_key()
    df = spark.createDataFrame(rows, "key string, time int, pos int, v string").repartition(5)
    out = numbered(
        df, ["key"] if keyed else [], ["time", "pos"], total="total",
        following={"after": F.col("v")}, preceding={"before": F.col("v")}, bucket=width and F.floor(F.col("time") / width),
    )
    assert out.columns == ["key", "time", "pos", "v", "idx", "total", "after", "before"]
    assert found(out) == expected(rows, keyed)


def test_hot_rows_are_spread(spark, many_parts):
    """No task gets a hot key alone."""
    from eventscope.operators.ordering import range_sorted

    df = spark.createDataFrame(rows_with_hot_key(), "key string, time int, pos int, v string")
    placed = range_sorted(df.where("key = 'hot'"), ["key", "time", "pos"])
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 100


def test_null_keys_are_a_group(spark, many_parts):
    rows = [(None, i % 7, i, f"v{i}") for i in range(60)] + [("a", 1, 100 + i, "x") for i in range(5)]
    df = spark.createDataFrame(rows, "key string, time int, pos int, v string")
    out = numbered(
        df, ["key"], ["time", "pos"], total="total",
        following={"after": F.col("v")}, preceding={"before": F.col("v")}, bucket=F.floor(F.col("time") / 3),
    )
    assert found(out) == expected(rows)


def test_null_times_come_first(spark, many_parts):
    rows = [("a", None if i % 5 == 0 else i % 4, i, None if i % 3 else f"v{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "key string, time int, pos int, v string")
    options = {"total": "total", "following": {"after": F.col("v")}, "preceding": {"before": F.col("v")}}
    by_window = numbered(df, ["key"], ["time", "pos"], **options)
    by_bucket = numbered(df, ["key"], ["time", "pos"], bucket=F.floor(F.col("time") / 2), **options)
    assert found(by_bucket) == found(by_window)


@pytest.mark.parametrize("rows_per_bucket", [20, 75, 10_000])
@pytest.mark.parametrize("keyed", [True, False])
def test_same_numbers_by_sketched_borders(spark, many_parts, rows_per_bucket, keyed):
    rows = rows_with_hot_key()
    df = spark.createDataFrame(rows, "key string, time int, pos int, v string").repartition(5)
    out = numbered(
        df, ["key"] if keyed else [], ["time", "pos"], total="total",
        following={"after": F.col("v")}, preceding={"before": F.col("v")}, along=F.col("time"), rows_per_bucket=rows_per_bucket,
    )
    assert out.columns == ["key", "time", "pos", "v", "idx", "total", "after", "before"]
    assert found(out) == expected(rows, keyed)


def test_buckets_follow_the_size_of_a_hot_day(spark, many_parts):
    """A third of all rows lie in one group and within one second of one day."""
    from eventscope.operators.ordering import _with_borders

    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", 10**12 + i if i % 3 == 0 else i * 10**9, i, "v") for i in range(3000)]
    df = spark.createDataFrame(rows + [("hot", None, -1, "v"), (None, 5, -2, "v")], "key string, time long, pos int, v string")
    cut = _with_borders(df, ["key"], F.col("time"), 100)
    sizes = (
        cut.where("key = 'hot' AND time IS NOT NULL")
        .groupBy(F.size(F.filter("_borders", lambda b: b <= F.col("time")))).count().collect()
    )
    assert len(sizes) in (10, 11) and max(r["count"] for r in sizes) < 250
    assert cut.where("key <> 'hot' AND _borders IS NOT NULL").count() == 0 and cut.count() == 3002
    out = numbered(df, ["key"], ["time", "pos"], along=F.col("time"), rows_per_bucket=100).where("key = 'hot'")
    assert [r.pos for r in out.orderBy("idx").collect()] == [-1, *range(0, 3000, 3)]


def test_stories_and_logs_by_sketched_borders(spark, many_parts):
    from eventscope.operators import sequences, sessions

    rows = [("a" if i % 3 else "b", f"e{i}", i // 2, i, str(i)) for i in range(200)]
    events = spark.createDataFrame(rows, "narrative_id string, event_key string, s long, pos long, latitude string").withColumns(
        {"datetime": F.timestamp_seconds("s"), "longitude": F.col("latitude"), "turn": F.col("pos").cast("int")}
    )
    for order in (["datetime", "pos"], ["turn"]):
        plain = sequences.steps_in_order(events, order)
        cut = sequences.steps_in_order(events, order, rows_per_bucket=15)
        assert sorted(map(tuple, cut.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
        near = [sequences.neighbours(events, ["narrative_id"], order, rows_per_bucket=n) for n in (None, 9)]
        assert sorted(map(repr, near[0].collect())) == sorted(map(repr, near[1].collect()))
    log = events.select(F.col("narrative_id").alias("session"), F.lit("x").alias("eventid"), (F.col("s") * 1000).alias("ms"), "pos")
    both = [sessions.occurrence_index(log, rows_per_bucket=n) for n in (None, 20)]
    assert sorted(map(repr, both[0].collect())) == sorted(map(repr, both[1].collect()))
