import json

import pytest
from pyspark.sql import functions as F

from eventscope import fixed_values as fixed
from eventscope.operators import logfields, sessions
from eventscope.sources.payloads import export_log, parse_log_lines
from tests.fixtures import EVENT_SCHEMA, EXPORT, c

KEYS = ["file", "session"]


@pytest.fixture(scope="module")
def log(spark):
    docs = spark.createDataFrame([("f", json.dumps(EXPORT))], "file string, text string")
    return export_log(docs)


@pytest.fixture(scope="module")
def built(log):
    rows = sessions.build_sessions(sessions.clean_log(log), KEYS, event_ids=True).collect()
    return {r.session: r for r in rows}


def test_log_keeps_position_and_text(log):
    rows = log.where("session = 'full'").orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(11))
    assert rows[0].duration == "9.25" and rows[1].src_port == "4242"
    assert json.loads(rows[1].raw) == EXPORT["full"]["events"][1]


def test_only_sessions_with_a_dated_event(built):
    assert set(built) == {"full", "tie", "part-dated"}
    row = built["part-dated"]
    assert (row.event_count, row.src_ip, row.location, row.duration_sec) == (1, "6.6.6.6", "Quay", 0)


def test_envelope_and_connect(built):
    full = built["full"]
    assert (full.src_ip, full.location, full.latitude) == ("9.9.9.9", "Harbour", "38.25")
    assert (full.src_port, full.dst_ip, full.dst_port) == ("4242", "10.0.0.1", "22")
    assert (full.event_count, full.duration_sec, full.stage) == (8, 9.25, c("command.input"))
    assert full.start_timestamp == "2026-04-06T12:00:01.000100Z"


def test_same_millisecond_goes_by_log_position(built):
    tie = built["tie"]
    assert tie.sensor == "second" and tie.start_timestamp.endswith("01.000900Z")
    assert tie.src_ip is None and tie.location is None
    assert (tie.src_port, tie.dst_ip, tie.dst_port) == ("", None, "0")
    assert tie.duration_sec == 0


def test_single_grouping_gives_the_same_sessions(log, built):
    rows = sessions.build_sessions(sessions.clean_log(log), KEYS).collect()
    for row in rows:
        other = built[row.session].asDict()
        assert {**row.asDict(), "event_ids": other["event_ids"]} == other


def test_groups_in_order_unknown_types_last(log, built):
    groups = sessions.session_groups(sessions.clean_log(log), KEYS).where("session = 'full'")
    rows = groups.orderBy("group_idx").collect()
    names = [c("session.connect"), c("login.failed"), c("login.success"), c("command.input"), c("session.closed"), "plugin.b", "plugin.a"]
    assert [r.eventid for r in rows] == names == built["full"].event_ids
    assert [r.event_count for r in rows] == [1, 2, 1, 1, 1, 1, 1]


def test_occurrence_index(log):
    rows = sessions.occurrence_index(sessions.clean_log(log), KEYS).where(
        F.col("eventid") == c("login.failed")
    )
    assert {(r.session, r.pos, r.occurrence) for r in rows.collect()} == {("full", 2, 0), ("full", 3, 1), ("tie", 0, 0)}


def examples():
    """Event ids of each step of the ladder, furthest first: those it names, and some below
    each of its prefixes."""
    named = {e for _, ids, _ in fixed.STAGES for e in ids}
    out = []
    for stage, ids, prefixes in fixed.STAGES:
        own = [*ids, *(p + tail for p in prefixes for tail in ("x", "x.y"))]
        out.append((stage, [e for e in own if e in ids or e not in named]))
    return out


def test_stage_of_every_event_and_of_every_two(spark):
    """The further of two steps counts, in whatever order they come."""
    steps = [(place, e) for place, (_, ids) in enumerate(examples()) for e in ids]
    pairs = [(a, b) for a in steps for b in steps]
    rows = [(f"{i}", e) for i, pair in enumerate(pairs) for _, e in pair]
    log = spark.createDataFrame(rows, "session string, eventid string")
    got = {int(r.session): r.stage for r in sessions.derive_stage(log).collect()}
    assert got == {i: fixed.STAGES[min(a, b)][0] for i, ((a, _), (b, _)) in enumerate(pairs)}


def test_events(log):
    rows = {r.id: r for r in sessions.log_to_events(log, KEYS).collect()}
    full, tie = rows["full"], rows["tie"]
    assert full.description == "full 9.9.9.9:4242 > 10.0.0.1:22 ssh"
    assert (full.date, full.time, full.time_precision) == ("04/06/2026", "12:00", "second")
    assert full.type == full.category == c("command.input") and full.colour == "#e8973a"
    assert full.associations[:2] == ["stage:" + c("command.input"), c("session.connect")]
    assert tie.description == "tie null: ssh" and tie.latitude == ""


def test_header(log):
    built = sessions.build_sessions(sessions.clean_log(log), KEYS)
    rows = sessions.session_header(built, KEYS).where("session = 'tie'").orderBy("place").collect()
    assert [(r.field, r.value) for r in rows] == [
        ("dst_port", "0"), ("protocol", "ssh"), ("timestamp", "2026-04-06T12:00:01.000900Z"),
        ("duration", "0"), ("sensor", "second"), ("uuid", "u-1"),
    ]


def test_parts_merge_to_the_same_sessions(log):
    clean = sessions.clean_log(log)
    pieces = [sessions.session_parts(clean.where(F.col("pos") % 3 == i), KEYS) for i in range(3)]
    merged = sessions.merge_parts(pieces[0].union(pieces[1]).union(pieces[2]), KEYS)
    got = sessions.sessions_from_parts(merged, KEYS)
    assert sorted(got.collect()) == sorted(sessions.build_sessions(clean, KEYS).collect())


def test_order_has_no_repeats():
    assert len(set(fixed.EVENT_ORDER)) == len(fixed.EVENT_ORDER) == 47


def raw_log(spark, *events):
    lines = [(i, json.dumps(e)) for i, e in enumerate(events)]
    return parse_log_lines(spark.createDataFrame(lines, "pos long, raw string"))


def test_field_order(spark):
    schema = spark.createDataFrame(
        [(e, i, f) for e, fields in EVENT_SCHEMA.items() for i, f in enumerate(fields)],
        "eventid string, pos int, field string",
    )
    log = raw_log(
        spark,
        {"eventid": c("login.failed"), "session": "s", "sensor": "h", "uuid": "u", "src_ip": "1", "protocol": "ssh",
         "zeta": 1, "message": "m", "alpha": 2, "password": "p", "timestamp": "t"},
        {"eventid": c("session.closed"), "duration": "0.0", "datetime": "d"},
        {"eventid": "undeclared", "b": None},
    )
    rows = logfields.field_coverage(log, schema).orderBy("pos").collect()
    assert rows[0].fields == ["timestamp", "password", "zeta", "alpha", "message"]
    assert rows[0].absent == ["username", "key"]
    assert (rows[1].fields, rows[1].absent) == (["duration"], ["duration_ms"])
    assert (rows[2].fields, rows[2].absent) == (["b"], [])


def test_values_as_text(spark):
    log = raw_log(spark, {
        "session": "s", "n": 1.5, "i": 3, "t": True, "null": None, "empty": [], "text": "",
        "list": ["a", 2, None, {"k": 1}, ["x"]], "object": {"k": [1]},
    })
    rows = logfields.explode_fields(log).collect()
    found = {}
    for row in sorted(rows, key=lambda r: (r.field, r.item)):
        found.setdefault(row.field, []).append(row.value)
    assert found == {
        "session": ["s"], "n": ["1.5"], "i": ["3"], "t": ["true"], "null": ["null"], "empty": ["[]"], "text": [""],
        "list": ["a", "2", "null", '{"k":1}', '["x"]'], "object": ['{"k":[1]}'],
    }
