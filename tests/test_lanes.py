import random
from datetime import datetime, timedelta

import pytest

from eventscope.operators import lanes


def by_loop(spans):
    """One span at a time, in the first slot whose span ended before."""
    ends, out = [], {}
    for key, start, end in sorted(spans, key=lambda s: (s[1], s[0])):
        lane = next((i for i, e in enumerate(ends) if e < start), len(ends))
        ends[lane : lane + 1] = [end]
        out[key] = lane
    return out


def laid(df, **options):
    return {r.first_key: r.lane for r in lanes.lowest_lanes(df, **options).collect()}


@pytest.mark.parametrize("seed, width, rows", [(1, 3, 20), (2, 30, 50), (3, 400, 30), (4, 0, 7), (5, 2000, 1000)])
def test_lowest_lane(spark, seed, width, rows):
    """Ranges with and without a place at which no span is open."""
    random.seed(seed)
    spans = [(i, s, s + random.randrange(width + 1)) for i, s in enumerate(random.choices(range(1000), k=300))]
    df = spark.createDataFrame(spans, "first_key int, start int, end int").repartition(4)
    assert laid(df, rows_per_range=rows) == by_loop(spans)


def test_a_span_over_all_ranges(spark):
    """No range but the first has a place without an open span: each waits for the one before."""
    random.seed(6)
    spans = [(0, -1, 10_000)] + [(i, 5 * i, 5 * i + random.randrange(40)) for i in range(1, 200)]
    df = spark.createDataFrame(spans, "first_key int, start int, end int")
    assert laid(df, rows_per_range=25) == by_loop(spans)


def test_times_and_offset(spark):
    zero = datetime(2026, 1, 1)
    random.seed(7)
    spans = [(i, zero + timedelta(hours=random.randrange(99)), zero + timedelta(hours=99, seconds=i)) for i in range(40)]
    df = spark.createDataFrame(spans, "first_key int, start timestamp, end timestamp")
    rows = lanes.lowest_lanes(df, 16, rows_per_range=9)
    assert {r.first_key: r.lane for r in rows.collect()} == by_loop(spans)
    assert rows.where("offset <> 16 * lane").isEmpty()


def test_missing_times(spark):
    spans = [(1, None, 5), (2, 1, None), (3, 6, 7), (4, 8, 9), (5, None, None)]
    df = spark.createDataFrame(spans, "first_key int, start int, end int")
    assert laid(df) == {1: 0, 5: 1, 2: 2, 3: 0, 4: 0}


def test_no_spans(spark):
    df = spark.createDataFrame([], "first_key int, start timestamp, end timestamp")
    assert lanes.lowest_lanes(df).columns == ["first_key", "start", "end", "lane", "offset"]
    assert laid(df) == {}
