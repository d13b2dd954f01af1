import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from eventscope.functions import paths, predicates as p, values as v
from eventscope.functions.text import snippets


def one(spark, expression, **values):
    columns = [F.lit(value).alias(name) for name, value in values.items()] or [F.lit(1).alias("one")]
    return spark.range(1).select(*columns).select(expression.alias("out")).collect()[0].out


@pytest.mark.parametrize("text, number", [
    ("", None), (None, None), ("1.5", 1.5), (" 2 ", 2.0), ("nope", None), ("1d", None), ("-.5e1", -5.0), ("3.", 3.0),
    ("  ", 0.0), ("1,5", None),
])
def test_to_number(spark, text, number):
    assert one(spark, v.to_number("t"), t=text) == number


@pytest.mark.parametrize("text, latitude, longitude", [
    ("90", True, True), ("-90.1", False, True), ("180", False, True), ("181", False, False), ("0", True, True),
    ("", False, False), (None, False, False), ("47,7", False, False), ("x", False, False),
])
def test_valid_coordinates(spark, text, latitude, longitude):
    assert one(spark, v.is_latitude("t"), t=text) is latitude
    assert one(spark, v.is_longitude("t"), t=text) is longitude


def test_decimal_point_takes_the_first_comma(spark):
    assert one(spark, v.decimal_point("t"), t="1,234,5") == "1.234,5"


@pytest.mark.parametrize("date, time, expected", [
    ("08/23/2011", "18:30", dt.datetime(2011, 8, 23, 18, 30)),
    ("8/3/2011", "", dt.datetime(2011, 8, 3)),
    ("8/3/2011", None, dt.datetime(2011, 8, 3)),
    ("08/23/2011", "18:30:59", dt.datetime(2011, 8, 23, 18, 30)),
    ("13/45/2020", "00:00", None),
    ("2011-08-23", "18:30", None),
    ("", "18:30", None),
    (None, "18:30", None),
])
def test_event_time(spark, date, time, expected):
    assert one(spark, v.event_time("d", "t"), d=date, t=time) == expected


def test_event_time_in_another_format(spark):
    out = one(spark, v.event_time("d", "t", "yyyy-MM-dd", "HH:mm:ss"), d="2026-04-06", t="1:02:03")
    assert out == dt.datetime(2026, 4, 6, 1, 2, 3)


@pytest.mark.parametrize("path, kind, short", [
    ("a.png", "Image", "Image"), ("a.jpeg ", "Image", "Unknown"), ("a.mp4", "Video", "Video"), ("a.md", "Text", "Text"),
    ("a.pdf", "Document", "Unknown"), ("https://twitter.com/x/status/1", "Tweet", "Unknown"),
    ("twitter.com/x", "Unknown", "Unknown"), ("https://t.me/x", "Telegram", "Unknown"), ("a.PNG", "Unknown", "Unknown"),
])
def test_media_type(spark, path, kind, short):
    assert one(spark, v.media_type("p"), p=path) == kind
    assert one(spark, v.media_type_short("p"), p=path) == short


def test_labels(spark):
    assert one(spark, v.nice_date("t"), t=dt.datetime(2026, 4, 6)) == "06 April, 2026"
    assert one(spark, v.tweet_id("u"), u="https://twitter.com/a_b/status/123?x") == "123"


def test_paths(spark):
    assert one(spark, paths.ancestors("p"), p="a/b/c") == ["a", "a/b"]
    assert one(spark, paths.parent("p"), p="a/b/c") == "a/b"
    assert one(spark, paths.parent("p"), p="a") is None
    assert one(spark, paths.path_leaf("p"), p="a/b/c") == "c"
    assert one(spark, paths.path_text("p"), p=["a", "b"]) == "a/b"


EVENTS = "id int, latitude string, longitude string, datetime timestamp"


@pytest.fixture(scope="module")
def events(spark):
    t = dt.datetime
    return spark.createDataFrame([
        (1, "10", "170", t(2026, 1, 1)),
        (2, "-10", "-170", t(2026, 1, 2)),
        (3, "", "", t(2020, 1, 1)),
        (4, "10", "0", t(2026, 1, 3)),
        (5, None, None, t(2020, 1, 1)),
    ], EVENTS)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_range_excludes_both_ends(events):
    assert ids(events.where(p.in_range("2026-01-01", "2026-01-03"))) == [2]
    kept = events.where(p.in_range("2026-01-01", "2026-01-03", keep_nonlocated=True))
    assert ids(kept) == [2, 3, 5]


def test_box(events):
    assert ids(events.where(p.in_box(-1, -20, 1, 20))) == [4]
    assert ids(events.where(p.in_box(160, -20, -160, 20))) == [1, 2]
    assert ids(events.where(p.in_box(-200, -20, 200, 20))) == [1, 2, 4]


def test_search(spark):
    rows = [(1, "Big FIRE", None), (2, "", "Firenze"), (3, None, "x")]
    df = spark.createDataFrame(rows, "id int, description string, location string")
    columns = ["description", "location"]
    assert ids(df.where(p.matches_text("fIrE", columns))) == [1, 2]
    assert ids(df.where(p.matches_text("", columns))) == []
    assert ids(df.where(p.matches_text("%", columns))) == []


def test_shapes_and_categories(spark):
    df = spark.sql("""
      select 1 id, named_struct('id', 's') shape, array(named_struct('mode', 'CATEGORY', 'title', 'A'), named_struct('mode', 'FILTER', 'title', 'B')) associations
      union all select 2, null, null""")
    assert ids(df.where(p.matches_shapes(["s", "t"]))) == [1]
    assert ids(df.where(p.matches_shapes([]))) == []
    assert ids(df.where(p.matches_categories(["A"]))) == [1]
    assert ids(df.where(p.matches_categories(["B"]))) == []
    assert ids(df.where(p.matches_categories([]))) == [1, 2]
    rows = df.select(p.active_categories(["B", "A"]).alias("c")).collect()
    assert sorted(r.c for r in rows) == [[], ["A"]]


def stretch_from(text, query, at, n):
    """End of the stretch that begins at ``at``, has ``n`` words before its hit, and then at
    most letters; None if there is none."""
    for _ in range(n):
        at = text.find(" ", at) + 1
        if not at:
            return None
    run = at
    while run < len(text) and text[run].isascii() and text[run].isalpha():
        run += 1
    hits = [q for q in range(at, run + 1) if text.startswith(query, q)]
    if not hits:
        return None
    end = hits[-1] + len(query)
    while end < len(text) and text[end].isascii() and text[end].isalpha():
        end += 1
    for _ in range(5):
        if text[end : end + 1] == " ":
            after = text.find(" ", end + 1)
            end = after if after >= 0 else len(text)
    return end


def by_definition(text, query):
    """Each place tried in turn, with six words before the hit, five, and so on."""
    first_words = "".join(w + " " for w in text.split(" ")[:-1][:10])
    text, query = text.lower(), query.lower()
    out, at = [], 0
    while at <= len(text):
        end = next((e for n in range(6, -1, -1) if (e := stretch_from(text, query, at, n)) is not None), None)
        if end is None:
            at += 1
        else:
            out.append("..." + text[at:end])
            at = end
    return out or [first_words]


def test_hits_in_long_runs_of_letters():
    import time

    from eventscope.functions.text import hits_with_words

    long = "q" * 1_000_000
    texts = [
        (long, 0), (f"fire {long}", 1), (f"one {long} fire two", 1), (f"{long}fire", 1),
        (f"a b c d {long}", 0), ("fire" * 100_000, 1), ("x.fire" * 100_000, 100_000),
    ]
    started = time.perf_counter()
    assert [len(hits_with_words(text, "fire")) for text, _ in texts] == [n for _, n in texts]
    assert time.perf_counter() - started < 7
    short = [t.replace(long, "q" * 40)[:200] for t, _ in texts]
    assert [["..." + h for h in hits_with_words(t, "fire")] for t in short if "fire" in t] == [
        by_definition(t, "fire") for t in short if "fire" in t
    ]


@pytest.mark.parametrize("query", ["fire", "a.b", "in the", "x", "é", "fir(e", " x", "the ", "Re w"])
def test_snippets_equal_the_definition(spark, query):
    import random

    random.seed(3)
    words = ["fire", "(fire)", "wildfires", "a.b", "axb", "in", "the", "x,", "word", "Café", "", "line\nbreak", "fir(e", "é"]
    weights = [1, 1, 1, 1, 1, 2, 2, 1, 30, 1, 1, 1, 1, 1]
    texts = [" ".join(random.choices(words, weights, k=random.randrange(120))) for _ in range(300)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "id int, text string")
    for row in df.withColumn("out", snippets("text", query)).collect():
        assert row.out == by_definition(row.text, query), row.text
