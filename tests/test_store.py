"""A domain written and read back; later loads touch their own days only."""

import json
from dataclasses import replace
from pathlib import Path

from pyspark.sql import functions as F

from eventscope.plans import store
from eventscope.plans.domain import load_domain
from tests.fixtures import EXPORT

DAYS = ["4/6/2026", "4/7/2026", "4/8/2026"]
SHAPES = [{"id": "s", "title": "S", "shape": "STAR", "colour": "#fff"}]
ASSOCIATIONS = [{"id": "t", "title": "T", "mode": "CATEGORY", "desc": "", "filter_paths": []}]


def loaded(spark, folder, name, events, large=False):
    for file, content in ((f"{name}.json", events), ("shapes.json", SHAPES), ("associations.json", ASSOCIATIONS)):
        (folder / file).write_text(json.dumps(content))
    paths = {"large_events" if large else "events": [str(folder / f"{name}.json")]}
    return load_domain(
        spark, dimensions={k: [str(folder / f"{k}.json")] for k in ("shapes", "associations")}, **paths
    )


def event(day, text, **more):
    return {"description": text, "date": day, "time": "10:00", "associations": ["t"], "sources": [], **more}


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_all_tables_read_back(spark, tmp_path):
    events = [event(d, f"e{i}") for d in DAYS for i in range(3)] + [{"description": "no date"}, event("x", "bad")]
    domain = loaded(spark, tmp_path, "a", events)
    store.write_domain(domain, str(tmp_path / "out"), "first")
    back = store.read_domain(spark, str(tmp_path / "out"))
    assert rows(back.events.drop(store.DAY)) == rows(domain.events) and back.events.count() == 9
    for name in (*store.DIMENSIONS, "rejects"):
        assert rows(getattr(back, name)) == rows(getattr(domain, name)), name
    assert back.event_schema is None and back.rejects.count() == 2


def test_a_later_load_leaves_other_days(spark, tmp_path):
    out = str(tmp_path / "out")
    store.write_domain(loaded(spark, tmp_path, "a", [event(d, "old") for d in DAYS] + [event("x", "bad")]), out, "first")
    before = files(f"{out}/events")
    second = loaded(spark, tmp_path, "b", [event(DAYS[1], "new"), event(DAYS[1], "newer"), event("y", "worse")])
    for _ in range(2):
        store.write_domain(second, out, "second")
    after = files(f"{out}/events")
    same = {p for p in before if "04-07" not in str(p)}
    assert len(same) == 2 and all(after[p] == before[p] for p in same)
    back = store.read_domain(spark, out)
    assert sorted(r.description for r in back.events.collect()) == ["new", "newer", "old", "old"]
    assert back.rejects.count() == 2


def test_merged_by_key(spark, tmp_path):
    out = str(tmp_path / "out")

    def keyed(name, events):
        domain = loaded(spark, tmp_path, name, events)
        return replace(domain, events=domain.events.withColumn("event_key", F.col("id")))

    store.merge_events(keyed("a", [event(d, f"old {d}", id=d) for d in DAYS] + [event(DAYS[1], "stays", id="k")]), out)
    before = files(f"{out}/events")
    store.merge_events(keyed("b", [event(DAYS[1], "new", id=DAYS[1]), event(DAYS[1], "more", id="m")]), out)
    after = files(f"{out}/events")
    same = {p for p in before if "04-07" not in str(p)}
    assert len(same) == 2 and all(after[p] == before[p] for p in same)
    found = store.read_domain(spark, out).events
    assert sorted(r.description for r in found.collect()) == sorted(["new", "more", "stays", f"old {DAYS[0]}", f"old {DAYS[2]}"])


def test_large_documents_load_as_others(spark, tmp_path):
    for name, content in (("a", [event(d, f"e, {d}") for d in DAYS] + [event("x", "bad")]), ("b", EXPORT)):
        whole, ranges = (loaded(spark, tmp_path, name, content, large) for large in (False, True))
        assert rows(ranges.events) == rows(whole.events) and rows(ranges.rejects) == rows(whole.rejects)
        assert whole.events.count()
