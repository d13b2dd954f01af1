"""Large documents cut into ranges of any size against reading them whole."""

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from eventscope.sources import payloads, ranges
from tests.fixtures import EXPORT

TRICKY = [
    {"description": 'a "quoted, text" with [brackets}, {and} commas', "date": "4/6/2026"},
    {"description": "back\\slash\\\\, at \\", "sources": ["x,y", "[", "\\\""], "own": {"a": [1, {"b": "]},{"}], "c": None}},
    {"description": "ünïcode, 中文,   ,", "time": "", "x": "1"},
    {"description": "", "associations": []}, {}, 5, "text, \"5\"", None, [], [1, [2, "]"]],
]


@pytest.fixture
def range_bytes(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield use
    for name in names:
        spark.conf.unset(name)


def rows(df):
    return sorted((repr(r) for r in df.collect()))


@pytest.mark.parametrize("size", [30, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_events_as_read_whole(spark, tmp_path, range_bytes, size, indent):
    draw = random.Random(size)
    for name in ("a", "b"):
        events = [draw.choice(TRICKY) for _ in range(12)]
        (tmp_path / f"{name}.json").write_text("\n " + json.dumps(events, indent=indent, ensure_ascii=name == "a") + "\n")
    paths = [str(tmp_path / "a.json"), str(tmp_path / "b.json")]
    whole = payloads.read_events(spark, paths)
    expected = rows(whole.rows)
    range_bytes(size)
    found = ranges.read_large_events(spark, paths)
    assert rows(found.rows) == expected and len(expected) == 24
    assert found.rejects.count() == 0
    if size < 50:
        pieces = ranges._pieces(spark.read.text(paths, lineSep=","))
        assert pieces.select("file", "block").distinct().count() > 10


@pytest.mark.parametrize("size", [25, 1 << 20])
def test_export_as_read_whole(spark, tmp_path, range_bytes, size):
    export = {**EXPORT, 'odd "id", {x}': {"src_ip": "1,2", "events": [{"eventid": "a,b", "session": "s", "input": "}\\\\"}]}, "none": {"location": "x"}}
    (tmp_path / "e.json").write_text(json.dumps(export))
    path = [str(tmp_path / "e.json")]
    expected = rows(payloads.read_session_export(spark, path).rows)
    range_bytes(size)
    found = ranges.read_large_export(spark, path)
    assert rows(found.rows) == expected and expected
    assert found.rejects.count() == 0


def test_empty_broken_and_missing(spark, tmp_path, range_bytes):
    texts = {"empty": "[]", "blank": " [ \n ] ", "cut": '[{"a": 1}, {"b": "x', "open": '[{"a": [1, 2}', "bad": '[{"description": "x"}, {oops, 1}]', "object": "{}"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    range_bytes(5)
    found = ranges.read_large_events(spark, [str(tmp_path / f"{n}.json") for n in (*texts, "lost")])
    assert [r.description for r in found.rows.collect()] == ["x"]
    messages = sorted((r.id.rsplit("/", 1)[-1], r.message) for r in found.rejects.collect())
    assert messages == [
        ("bad.json", "element is not JSON"), ("cut.json", "events could not be read"),
        ("lost.json", "events could not be read"), ("open.json", "events could not be read"),
    ]


def test_ranges_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(TRICKY))
    text, _ = ranges.elements(spark, [str(tmp_path / "a.json")])
    plan = text._jdf.queryExecution().executedPlan().toString()
    # What is shuffled: the summaries of ranges, and elements that cross a range's end.
    assert "SortMergeJoin" not in plan and "ArrowEvalPython" not in plan


values = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | st.text('ab,"\\[]{}é: ', max_size=6),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text('a,"{', max_size=3), inner, max_size=3),
    max_leaves=12,
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(document=st.lists(values, max_size=8), size=st.integers(1, 40))
def test_any_document(spark, tmp_path, range_bytes, document, size):
    (tmp_path / "any.json").write_text(json.dumps(document))
    range_bytes(size)
    found, rejects = ranges.elements(spark, [str(tmp_path / "any.json")])
    assert [json.loads(r.text) for r in found.orderBy("number").collect()] == document
    assert rejects.count() == 0
