import json

import pytest

from eventscope.operators import contracts
from eventscope.sources import dimensions, payloads, sinks
from tests.fixtures import ASSOCIATIONS, EVENT_SCHEMA, EXPORT, PLAIN, REGIONS, SITES, SOURCES, write_json


def test_tell_payloads_apart(spark):
    texts = [json.dumps(v) for v in (EXPORT, [{"id": "a"}], None, {"a": {"events": 3}}, {"a": 1}, {}, 5)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file int, text string").selectExpr(
        "file", "text", "try_parse_json(text) doc"
    )
    rows = payloads.classify_payloads(docs).orderBy("file").collect()
    assert [r.is_session_export for r in rows] == [True, False, False, False, False, False, False]


def test_read_events_from_several_payloads(spark, tmp_path):
    paths = [
        write_json(tmp_path, "a.json", PLAIN), write_json(tmp_path, "b.json", PLAIN[:1]),
        write_json(tmp_path, "export.json", EXPORT), str(tmp_path / "missing.json"),
    ]
    (tmp_path / "broken.json").write_text("{nope")
    read = payloads.read_events(spark, [*paths, str(tmp_path / "broken.json")], [("custom", "text")])
    rows = read.rows.orderBy("pos").collect()
    assert [r.id for r in rows] == [str(e["id"]) for e in PLAIN] + ["a"]
    assert rows[0].custom == "text" and rows[0].extra == {"more": '{"k":1}'}
    assert rows[0].associations == ["cat:x", "f:deep", "unknown", "dup"]
    assert sorted(rows[9].type_errors) == ["description must be text", "id must be text", "sources must be a list"]
    lost = {r.id.rsplit("/", 1)[1] for r in read.rejects.collect()}
    assert lost == {"missing.json", "broken.json"}


def test_read_event_lines(spark, tmp_path):
    path = tmp_path / "events.jsonl"
    path.write_text("\n".join([json.dumps(PLAIN[0]), "", "[1]", "nope", json.dumps(PLAIN[1])]))
    read = payloads.read_event_lines(spark, [str(path)])
    assert [r.id for r in read.rows.orderBy("pos").collect()] == ["a", "b"]
    assert sorted(r.row_json for r in read.rejects.collect()) == ["[1]", "nope"]
    nothing = payloads.read_event_lines(spark, [str(tmp_path / "none")])
    assert nothing.rows.count() == 0 and nothing.rejects.count() == 1


def test_read_session_log(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join([*(json.dumps(e) for e in EXPORT["full"]["events"]), "nope"]))
    read = payloads.read_session_log(spark, [str(path)])
    rows = read.rows.orderBy("pos").collect()
    assert len(rows) == 11 and {r.session for r in rows} == {"full"}
    assert rows[2].eventid == "cowrie.login.failed"
    assert read.rejects.collect()[0].message == "line is not a JSON object"
    nothing = payloads.read_session_log(spark, [str(tmp_path / "none")])
    assert nothing.rows.columns == read.rows.columns


def test_dimensions(spark, tmp_path):
    def read(kind, value):
        return dimensions.read_dimension(spark, kind, [write_json(tmp_path, f"{kind}.json", value)]).rows

    schema = read("event_schema", EVENT_SCHEMA)
    assert {(r.eventid, r.pos, r.field) for r in schema.collect()} == {
        (e, i, f) for e, fields in EVENT_SCHEMA.items() for i, f in enumerate(fields)
    }
    ok, bad = contracts.validate_dimension("sources", read("sources", SOURCES))
    assert [r.source_id for r in ok.collect()] == ["s1"]
    assert [(r.id, r.message) for r in bad.collect()] == [("bad", "paths must be a list")]
    ok, bad = contracts.validate_dimension("sites", read("sites", SITES))
    assert ok.count() == 4 and bad.collect()[0].message == "site is required"
    assert [r.id for r in contracts.enabled_sites(ok).collect()] == ["0"]
    ok, bad = contracts.validate_dimension("regions", read("regions", REGIONS))
    assert bad.collect()[0].message == "name must not be empty"
    points = contracts.parse_regions(ok).collect()[0].points
    assert [(p.lat, p.lon) for p in points] == [(1.5, 2.0), (3.0, 4.0), (5.0, 6.0)]
    ok, bad = contracts.validate_dimension("associations", read("associations", ASSOCIATIONS))
    assert [(r.id, r.message) for r in bad.collect()] == [("broken", "title is required")]
    assert [(r.id, r.title, r.pos) for r in contracts.duplicate_keys(ok, "id", "pos").collect()] == [("dup", "Second", 4)]
    first = {r.id: r.title for r in contracts.first_definitions(ok).collect()}
    assert first["dup"] == "First" and len(first) == 5


def test_missing_dimension_is_empty(spark, tmp_path):
    read = dimensions.read_dimension(spark, "sites", [str(tmp_path / "none.json")])
    assert read.rows.count() == 0 and read.rejects.collect()[0].table == "sites"


def test_written_events_are_pruned_by_day(spark, tmp_path):
    from eventscope.functions.predicates import in_range

    events = spark.sql(
        "select id, timestamp '2026-04-01 12:00:00' + make_interval(0, 0, 0, cast(id as int)) datetime from range(10)"
    )
    path = str(tmp_path / "events")
    sinks.write_events(events, path, "error")
    back = sinks.read_written_events(spark, path)
    found = back.where(in_range("2026-04-03", "2026-04-06", day="event_date"))
    assert sorted(r.id for r in found.collect()) == [2, 3, 4]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


@pytest.mark.parametrize("kind", ["associations", "sources", "sites", "regions", "shapes"])
def test_empty_dimension(spark, kind):
    from eventscope.plans.domain import empty_dimension

    ok, bad = contracts.validate_dimension(kind, empty_dimension(spark, kind))
    assert ok.count() == bad.count() == 0
