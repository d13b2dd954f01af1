"""Small hand-made inputs in the shapes of FIXTURES.md."""

import json


def log_event(session, eventid, second, **fields):
    return {
        "eventid": eventid, "session": session, "timestamp": f"2026-04-06T12:00:{second:09.6f}Z",
        "sensor": "honeypot", "uuid": "u-1", "src_ip": "1.2.3.4", "protocol": "ssh", **fields,
    }


def c(name):
    return f"cowrie.{name}"


EXPORT = {
    "full": {
        "src_ip": "9.9.9.9", "location": "Harbour", "latitude": "38.25", "longitude": "-9.5",
        "events": [
            log_event("full", c("session.closed"), 9.5, duration="9.25", message="closed"),
            log_event("full", c("session.connect"), 1.000100, src_port=4242, dst_ip="10.0.0.1", dst_port=22),
            log_event("full", c("login.failed"), 2, username="root", password="a"),
            log_event("full", c("login.failed"), 3, username="root", password="b"),
            log_event("full", c("login.success"), 4, username="root", password="c"),
            log_event("full", "plugin.b", 4.5),
            log_event("full", "plugin.a", 4.6),
            log_event("full", c("command.input"), 5, input="ls"),
            {"session": "full", "timestamp": "2026-04-06T12:00:06Z"},
            log_event("full", "", 6),
            {"eventid": c("command.input"), "session": "full", "timestamp": "nope"},
        ],
    },
    "tie": {
        "src_ip": "", "location": "", "latitude": "", "longitude": "",
        "events": [
            log_event("tie", c("login.failed"), 1.000900, src_ip="", sensor="second"),
            log_event("tie", c("session.connect"), 1.000100, src_ip="5.5.5.5", sensor="first", src_port="", dst_ip="", dst_port=0),
        ],
    },
    "no-times": {"src_ip": "8.8.8.8", "events": [
        log_event("no-times", c("login.failed"), 1, timestamp="yesterday"),
        {"eventid": c("command.input"), "session": "no-times", "timestamp": ""},
        {"eventid": c("login.success"), "session": "no-times"},
    ]},
    "part-dated": {"location": "Quay", "events": [
        log_event("part-dated", c("login.failed"), 2, timestamp="02 o'clock"),
        log_event("part-dated", "", 3),
        log_event("part-dated", c("client.version"), 4, src_ip="6.6.6.6"),
    ]},
    "quiet": {"src_ip": "7.7.7.7", "events": []},
    "bare": {"latitude": "1"},
}

PLAIN = [
    {"id": "a", "description": "one", "date": "08/23/2011", "time": "18:30", "location": "Here",
     "latitude": "47,7", "longitude": "32,25", "associations": ["cat:x", "f:deep", "unknown", "dup"],
     "sources": ["s1", "nope"], "shape": "", "custom": "text", "more": {"k": 1}},
    {"id": "b", "description": "two", "date": "8/3/2011", "time": "", "latitude": "", "longitude": "",
     "associations": ["story"], "shape": "star"},
    {"id": "skipped", "description": "", "date": "", "time": ""},
    {"id": "bad-date", "description": "x", "date": "13/45/2020", "time": "00:00", "latitude": "1", "longitude": "2"},
    {"id": "bad-shape", "description": "x", "date": "01/02/2020", "time": "", "latitude": "1", "longitude": "2", "shape": "hexagon"},
    {"id": "both-bad", "description": "x", "date": "nope", "time": "", "latitude": "1", "longitude": "2", "shape": "hexagon"},
    {"id": "no-description", "date": "01/02/2020", "latitude": "1", "longitude": "2"},
    {"id": "half", "description": "x", "date": "01/02/2020", "latitude": "1"},
    {"id": "nowhere", "description": "x", "time": "10:00"},
    {"id": 7, "description": None, "date": "01/02/2020", "latitude": "1", "longitude": "2", "sources": "s1"},
]

ASSOCIATIONS = [
    {"id": "cat:x", "title": "X", "desc": "", "mode": "CATEGORY", "filter_paths": ["default"]},
    {"id": "f:deep", "title": "Deep", "mode": "FILTER", "filter_paths": ["a", "b", "c"]},
    {"id": "f:mid", "title": "Mid", "mode": "FILTER", "filter_paths": ["a", "b"]},
    {"id": "dup", "title": "First", "mode": "FILTER", "filter_paths": ["d"]},
    {"id": "dup", "title": "Second", "mode": "FILTER", "filter_paths": ["e"]},
    {"id": "story", "title": "Story", "mode": "NARRATIVE"},
    {"id": "broken", "mode": "FILTER"},
]
SHAPES = [
    {"id": "star", "title": "Star", "shape": "STAR", "colour": "#fff"},
    {"id": "blank", "title": "Blank", "shape": "", "colour": "#fff"},
]
SITES = [
    {"id": str(i), "description": "", "site": "s", "latitude": "1", "longitude": "2", **({} if e is None else {"enabled": e})}
    for i, e in enumerate(["1", "0", "", None])
] + [{"id": "x", "description": "no site", "latitude": "1", "longitude": "2"}]
SOURCES = {
    "s1": {"id": "s1", "title": "Source", "paths": ["a.png", "b.mp4", "c.png"], "affil_s": ""},
    "": {"id": "e", "paths": []},
    "bad": {"id": "bad", "paths": "a.png"},
}
REGIONS = [{"name": "r", "items": ["1.5, 2", " 3 ,4", "5,6"]}, {"name": "", "items": []}]
EVENT_SCHEMA = {
    c("login.failed"): ["eventid", "message", "timestamp", "session", "username", "password", "key"],
    c("session.closed"): ["eventid", "message", "timestamp", "duration_ms"],
}


def write_json(folder, name, value):
    path = folder / name
    path.write_text(json.dumps(value))
    return str(path)
