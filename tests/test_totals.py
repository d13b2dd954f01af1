import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from eventscope.operators import groups, spatial, timeline
from eventscope.plans import totals

SCHEMA = "event_key string, datetime timestamp, track string, location string, latitude string, longitude string"
WIDTHS = [60, 720, 1440, 4320]


def events(spark, seed, n=300):
    random.seed(seed)
    rows = []
    for i in range(n):
        lat = random.choice(["1.5", "2.5", "", "99", None])
        when = datetime(2026, 4, 1) + timedelta(minutes=random.randrange(8 * 1440))
        rows.append((f"{seed}-{i}", when, random.choice("abc"), random.choice(["x", "y", None]), lat, "10"))
    rows.append((f"{seed}-none", None, "a", "x", "1", "1"))
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def loads(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("totals"))
    parts = [events(spark, seed) for seed in (1, 2, 3)]
    for i, part in enumerate(parts):
        totals.add_load(part, folder, f"load{i}")
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return folder, parts, everything.where("datetime IS NOT NULL").cache()


def test_three_loads_equal_one(spark, loads):
    folder, _, everything = loads
    assert rows_of(totals.read_activity(spark, folder, WIDTHS)) == rows_of(timeline.activity_at(everything, WIDTHS))
    places = totals.read_places(spark, folder)
    assert rows_of(places) == rows_of(groups.group_locations(everything))
    got, want = (spatial.cluster(spatial.project(p), [2, 5]) for p in (places, groups.group_locations(everything)))
    assert rows_of(got.drop("longitude", "latitude")) == rows_of(want.drop("longitude", "latitude"))


def test_a_load_run_again_changes_nothing(spark, loads):
    folder, parts, _ = loads
    before = rows_of(totals.read_activity(spark, folder, WIDTHS))
    totals.add_load(parts[1], folder, "load1")
    assert rows_of(totals.read_activity(spark, folder, WIDTHS)) == before


def test_days_are_pruned(spark, loads):
    folder, _, everything = loads
    some = totals.read_places(spark, folder, first="2026-04-03", last="2026-04-04")
    assert rows_of(some) == rows_of(groups.group_locations(everything.where("to_date(datetime) between '2026-04-03' and '2026-04-04'")))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_compacted(spark, loads, tmp_path):
    folder, _, everything = loads
    totals.compact(spark, folder, str(tmp_path / "one"), "all")
    assert {p.name for p in (Path(tmp_path) / "one" / "places").iterdir() if p.is_dir()} == {"load=all"}
    one = str(tmp_path / "one")
    assert rows_of(totals.read_activity(spark, one, WIDTHS)) == rows_of(totals.read_activity(spark, folder, WIDTHS))
    assert rows_of(totals.read_places(spark, one)) == rows_of(groups.group_locations(everything))


def test_widths_that_do_not_fit(spark, loads):
    with pytest.raises(ValueError):
        totals.read_activity(spark, loads[0], [90])
    with pytest.raises(ValueError):
        totals.add_load(events(spark, 4), loads[0], "x", minutes=7)
