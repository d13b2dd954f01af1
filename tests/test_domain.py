import datetime as dt
import json

import pytest

from eventscope.functions.predicates import in_range
from eventscope.operators import groups, links, selection, sequences
from eventscope.plans.domain import load_domain
from eventscope.plans.view import View
from tests.fixtures import (
    ASSOCIATIONS, EVENT_SCHEMA, EXPORT, PLAIN, REGIONS, SHAPES, SITES, SOURCES, c, write_json,
)


@pytest.fixture(scope="module")
def domain(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("domain")
    stages = [
        {"id": f"stage:{c('command.input')}", "title": c("command.input"), "mode": "CATEGORY", "filter_paths": ["default"]},
        {"id": c("login.success"), "title": "Success", "mode": "FILTER", "filter_paths": ["login", "success"]},
    ]
    tables = {
        "associations": ASSOCIATIONS + stages, "shapes": SHAPES, "sites": SITES, "sources": SOURCES,
        "regions": REGIONS, "event_schema": EVENT_SCHEMA,
    }
    return load_domain(
        spark,
        [write_json(folder, "plain.json", PLAIN), write_json(folder, "export.json", EXPORT)],
        {k: [write_json(folder, f"{k}.json", v)] for k, v in tables.items()},
        custom_fields=[("custom", "text")],
    )


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_events_are_linked(domain):
    events = by_id(domain.events)
    assert set(events) == {"a", "b", "full", "tie", "part-dated"}
    a, b = events["a"], events["b"]
    assert (a.latitude, a.longitude) == ("47.7", "32.25")
    assert a.datetime == dt.datetime(2011, 8, 23, 18, 30) and b.datetime == dt.datetime(2011, 8, 3)
    assert [x.title for x in a.associations] == ["X", "Deep", "First"]
    assert b.shape.shape == "STAR" and a.shape is None
    full = events["full"]
    assert [x.id for x in full.associations] == [f"stage:{c('command.input')}", c("login.success")]
    assert full.session == "full" and a.session is None


def test_bulk_lines_give_the_same_events(spark, tmp_path):
    def lines(name, values):
        path = tmp_path / name
        path.write_text("\n".join(map(json.dumps, values)))
        return [str(path)]

    log = [e for s in ("full", "tie") for e in EXPORT[s]["events"]]
    domain = load_domain(spark, event_lines=lines("e.jsonl", PLAIN), log_lines=lines("l.jsonl", log))
    events = by_id(domain.events)
    assert set(events) == {"a", "full", "tie"}
    assert events["full"].category == c("command.input") and events["full"].latitude == ""
    assert domain.rejects.count() == 8
    keys = [r.event_key for r in domain.events.collect()]
    assert len(set(keys)) == 3


def test_rejects_say_why(domain):
    found = {r.id: r.message for r in domain.rejects.where("table = 'events'").collect()}
    assert found == {
        "bad-date": "date or time cannot be read",
        "bad-shape": "shape is not known",
        "both-bad": "shape is not known; date or time cannot be read",
        "no-description": "description is required",
        "half": "latitude and longitude must come together",
        "nowhere": "date or latitude must be given",
        "7": "id must be text; description must be text; sources must be a list",
    }


def test_summary(domain):
    found = {r.table: r.rejected for r in domain.rejects_summary().collect()}
    assert found == {"events": 7, "associations": 2, "sites": 1, "sources": 1, "regions": 1, "shapes": 1}


def test_switched_off_tables_are_empty(domain):
    off = domain.with_features(sites=False, sources=True)
    assert off.sites.count() == 0 and off.sources.count() == 1


def test_selection(domain):
    def ids(**view):
        shown = selection.select_events(domain.events, View("2000-01-01", "2030-01-01", **view))
        return sorted(r.id for r in shown.collect())

    assert ids() == ["a", "b", "full", "part-dated", "tie"]
    assert ids(categories=(c("command.input"),)) == ["full"]
    assert ids(filters=("login/success",)) == ["full"]
    assert ids(filters=("a/b/c", "login/success")) == ["a", "full"]
    assert ids(filters=("login/success",), categories=("X",)) == []
    both = View("2026-01-01", "2026-12-31", keep_nonlocated=True)
    assert sorted(r.id for r in selection.select_events(domain.events, both).collect()) == ["b", "full", "part-dated", "tie"]
    assert selection.count_located(domain.events, View("2000-01-01", "2030-01-01")).collect()[0].events == 2
    assert domain.events.where(in_range("2011-08-03", "2011-08-23 18:30:00")).count() == 0


def test_sources_keep_their_place(domain):
    rows = by_id(links.attach_sources(domain.events, domain.sources, fields=["id", "title"]))
    assert [s and s.title for s in rows["a"].sources] == ["Source", None]
    assert rows["b"].sources == []


def test_stories_and_places(domain):
    steps = sequences.narrative_steps(domain.events).collect()
    assert [(s.narrative_id, s.id, s.step_idx, s.steps) for s in steps] == [("story", "b", 0, 1)]
    places = groups.group_locations(domain.events).collect()
    assert {p.location: p.events for p in places} == {"Here": 1, "Harbour": 1}
    cards = selection.timeline_events(domain.events)
    assert "session" not in cards.columns
