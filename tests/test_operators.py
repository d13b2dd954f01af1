import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from eventscope.operators import groups, hierarchy, links, sequences, spatial, timeline
from eventscope.plans.view import View

T0 = dt.datetime(2026, 4, 6)


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


def ids(df, column="event_key"):
    return sorted(r[column] for r in df.collect())


# Links


def test_coevents_of_one_event(spark):
    rows = [(1, minutes(0)), (2, minutes(0)), (3, minutes(1)), (4, minutes(0)), (5, minutes(2))]
    df = spark.createDataFrame(rows, "event_key int, datetime timestamp")
    found = links.coevents(df, df.where("event_key = 2")).collect()
    assert {(r.event_key, r.is_selected) for r in found} == {(1, False), (2, True), (4, False)}
    assert links.coevent_counts(df).collect()[0].events == 3


@pytest.mark.parametrize("width", [1, 2, 3, 10, 61])
def test_neighbourhood_equals_all_pairs(spark, width):
    random.seed(width)
    times = [T0 + dt.timedelta(milliseconds=random.randrange(4 * 3600_000)) for _ in range(300)]
    times += [minutes(m) for m in range(0, 240, 5)]
    df = spark.createDataFrame(list(enumerate(times)), "event_key int, datetime timestamp")
    anchors = [(i, t) for i, t in enumerate(times) if i % 29 == 0]
    reach = dt.timedelta(minutes=width // 2)
    expected = [i for i, t in enumerate(times) if any(abs(t - a) < reach for _, a in anchors)]
    near = links.neighbourhood(df, spark.createDataFrame(anchors, df.schema), width)
    assert ids(near) == expected


def test_by_keys_keeps_the_list(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "session string, n int")
    found = links.by_keys(df, links.key_list(spark, ["c", "zz", "a", "c"])).orderBy("list_pos")
    assert [(r.list_pos, r.session) for r in found.collect()] == [(0, "c"), (2, "a"), (3, "c")]


def test_paths_and_ids(spark):
    filters = spark.createDataFrame(
        [("f1", ["a", "b"], 0), ("f2", ["a"], 1), ("f3", ["a"], 2), ("f4", None, 3)],
        "id string, filter_paths array<string>, pos int",
    )
    asked = spark.createDataFrame([(0, "a/b"), (1, "a"), (2, "zz")], "n int, path string")
    assert {(r.n, r.id) for r in links.paths_to_ids(asked, filters).collect()} == {(0, "f1"), (1, "f3")}
    named = spark.createDataFrame([(0, "f1"), (1, "f4"), (2, "zz")], "n int, id string")
    assert {(r.n, r.path) for r in links.ids_to_paths(named, filters).collect()} == {(0, "a/b")}


@pytest.mark.parametrize("keep", [True, False])
def test_refs(spark, keep):
    table = spark.createDataFrame([("a", "A"), ("b", 'quote " \\'), ("c", None)], "id string, title string")
    df = spark.createDataFrame([(1, ["b", "x", "a", "b"]), (2, []), (3, None), (4, ["x"]), (5, ["c"])], "event_key int, refs array<string>")
    out = links.resolve_refs(df, "refs", table, keep_unknown=keep)
    found = {r.event_key: [o and o.title for o in r.refs] for r in out.collect()}
    gap = [None] if keep else []
    assert found == {1: ['quote " \\', *gap, "A", 'quote " \\'], 2: [], 3: [], 4: gap, 5: [None]}


@pytest.mark.parametrize("n", [200, 201, 1000])
def test_refs_whatever_the_size_of_the_lookup(spark, n):
    """Keys given twice or not at all, ids that are numbers, and exact times."""
    at = dt.datetime(2026, 4, 6, 1, 2, 3, 456789)
    table = spark.createDataFrame([(i, f"t{i}", at) for i in range(n)], "id long, title string, at timestamp")
    rows = [(1, [5]), (1, [7, 5]), (None, [5]), (2, [5, None, 10**9, 5]), (3, None), (None, [])]
    df = spark.createDataFrame(rows, "event_key int, refs array<long>")
    out = links.resolve_refs(df, "refs", table).collect()
    found = sorted(((r.event_key, [(o.title, o.at) for o in r.refs]) for r in out), key=repr)
    expected = [(k, [(f"t{i}", at) for i in refs or [] if i is not None and i < n]) for k, refs in rows]
    assert found == sorted(expected, key=repr)


# Groups


def tagged(*paths, mode="FILTER"):
    return [("i", p, mode, p.split("/")) for p in paths]


TAGGED = "event_key int, place string, associations array<struct<id string, title string, mode string, filter_paths array<string>>>"


def test_colour_shares(spark):
    df = spark.createDataFrame([
        (1, "p", tagged("a", "b/c")), (2, "p", tagged("b/c")), (3, "q", tagged("zz")), (4, "r", None), (5, "p", tagged("a")),
    ], TAGGED)
    def shares(sets):
        return sorted((r.place, r.set_idx, r.hits, r.share) for r in groups.colour_shares(df, "place", sets).collect())

    assert shares([["a", "b/c"], ["b/c"], ["none"]]) == [
        ("p", 0, 2, 0.5), ("p", 1, 2, 0.5), ("p", 2, 0, 0.0), ("q", 0, 0, 1.0), ("r", 0, 0, 1.0)
    ]
    assert shares([]) == [("p", 0, 0, 1.0), ("q", 0, 0, 1.0), ("r", 0, 0, 1.0)]


def test_locations_and_spans(spark):
    rows = [
        (3, "L", "1", "2", "p", minutes(3), "late"), (1, "L", "1", "2", "p", minutes(5), "first"),
        (2, "L", "1.0", "2", "p", minutes(4), "x"), (4, "L", "91", "2", "p", minutes(4), "x"),
        (5, "", "", "", "p", minutes(9), "first"), (6, "", "", "", "p", minutes(1), "x"),
        (7, "", "", "", None, minutes(1), "x"), (8, "", "", "", "q", minutes(1), "y"),
    ]
    df = spark.createDataFrame(rows, "event_key int, location string, latitude string, longitude string, project string, datetime timestamp, category string")
    places = groups.group_locations(df).collect()
    assert {(r.label, r.location_id, r.events) for r in places} == {("L$_1_2", 1, 2), ("L$_1.0_2", 2, 1)}
    spans = {r.project: r for r in groups.project_spans(df, "project").collect()}
    assert set(spans) == {"p", "q"}
    assert (spans["p"].start, spans["p"].end, spans["p"].category) == (minutes(1), minutes(9), "first")
    flagged = links.flag_selected_locations(groups.group_locations(df), df.where("event_key = 3"))
    assert {r.label for r in flagged.where("is_selected").collect()} == {"L$_1_2"}


def test_panels(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", None)], "id string, filter_paths array<string>")
    assert [r.panel for r in groups.categories_by_panel(df, ["x", "z"]).orderBy("id").collect()] == ["x", None]
    assert [r.panel for r in groups.categories_by_panel(df, ["x"]).collect()] == ["default"] * 2


# Stories


STORY = "event_key int, datetime timestamp, pos int, latitude string, longitude string, associations array<struct<id string, title string, mode string, filter_paths array<string>>>, narrative___stepStyles array<string>"


def story(name):
    return (name, name, "NARRATIVE", [])


@pytest.fixture(scope="module")
def stories(spark):
    return spark.createDataFrame([
        (1, minutes(2), 1, "10", "20", [story("n"), *tagged("a")], ["solid"]),
        (2, minutes(1), 2, "0", "0", [story("m"), story("n")], ["solid", "None"]),
        (3, minutes(2), 0, "", "", [story("n")], ["solid"]),
        (4, minutes(3), 4, "30", "-20", [story("n"), *tagged("a", "b")], ["dots"]),
        (5, minutes(4), 5, "40", "-30", [story("n")], None),
    ], STORY)


def test_steps_and_legs(spark, many_parts, stories):
    steps = sequences.narrative_steps(stories)
    rows = {(r.narrative_id, r.event_key): (r.step_idx, r.steps, r.has_previous, r.has_next) for r in steps.collect()}
    assert rows == {
        ("m", 2): (0, 1, False, False), ("n", 2): (0, 5, False, True), ("n", 3): (1, 5, True, True),
        ("n", 1): (2, 5, True, True), ("n", 4): (3, 5, True, True), ("n", 5): (4, 5, True, False),
    }
    legs = {(r.from_key, r.to_key) for r in sequences.narrative_legs(steps).collect()}
    assert legs == {(1, 4), (4, 5)}
    marked = sequences.narrative_legs(sequences.marked_steps(stories))
    assert {(r.narrative_id, r.from_key, r.to_key) for r in marked.collect()} == {("n", 1, 4), ("n", 4, 5)}
    picked = stories.where("event_key in (1, 5)")
    assert {(r.event_key, r.step_idx) for r in sequences.step_of(steps, picked).collect()} == {(1, 2), (5, 4)}
    assert {(r.event_key, r.step_idx) for r in sequences.first_step_of(steps, picked).collect()} == {(1, 2), (5, 4)}
    assert ids(sequences.step_at(steps, 4)) == [5] and ids(sequences.step_at(steps, 9)) == []
    assert ids(links.only_in_narrative(stories, steps.where("narrative_id = 'm'"))) == [2]


def test_story_of_filters(stories):
    steps = sequences.narrative_from_filters(stories, ["b", "a"]).orderBy("step_idx").collect()
    assert [(s.narrative_id, s.event_key) for s in steps] == [("b-a", 1), ("b-a", 4)]
    assert sequences.narrative_from_filters(stories, []).count() == 0


@pytest.mark.parametrize("limits", [None, (T0 - dt.timedelta(days=3), T0 + dt.timedelta(minutes=30))])
def test_extent(spark, limits):
    """The box holds every located step; a located first step is its middle; and it is the
    smallest such box. The time range is that of the steps and the limits, and a tenth more."""
    def ms(t):
        return int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)

    random.seed(1)
    rows, stories = [], {}
    for n in range(40):
        steps = stories[n] = []
        for _ in range(random.randrange(1, 6)):
            place = ("", "") if random.random() < 0.4 else (str(random.randrange(-80, 80)), str(random.randrange(-170, 170)))
            steps.append((random.randrange(100), *place))
        steps.sort(key=lambda s: s[0])
        rows += [(n, i, minutes(m), a, b) for i, (m, a, b) in enumerate(steps)]
    df = spark.createDataFrame(rows, "narrative_id int, step_idx int, datetime timestamp, latitude string, longitude string")
    for r in sequences.narrative_extent(df, limits, order=["step_idx"]).collect():
        steps = stories[r.narrative_id]
        for place, low, high in ((1, r.south, r.north), (2, r.west, r.east)):
            at = [float(s[place]) for s in steps if s[place] != ""]
            if not at:
                assert low == 180 and high == -180
            elif steps[0][place] == "":
                assert (low, high) == (min(at), max(at))
            else:
                reach = max(abs(x - at[0]) for x in at)
                assert (low, high) == pytest.approx((at[0] - reach, at[0] + reach))
        times = [ms(minutes(s[0])) for s in steps]
        first, last = (min(times[0], *times, *map(ms, limits or ())), max(*times, times[0], *map(ms, limits or ())))
        start = first - (last - first) / 10
        assert (r.start_ms, r.end_ms) == pytest.approx((start, last + (last - start) / 10))


def test_neighbours(spark, many_parts, stories):
    rows = sequences.neighbours(stories).collect()
    assert {(r.event_key, r.previous_key, r.next_key) for r in rows} == {
        (2, None, 3), (3, 2, 1), (1, 3, 4), (4, 1, 5), (5, 4, None)
    }


def test_region_segments(spark):
    df = spark.createDataFrame(
        [("r", [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]), ("one", [(1.0, 2.0)]), ("none", [])],
        "name string, points array<struct<lat double, lon double>>",
    )
    rows = sorted(tuple(r) for r in sequences.region_segments(df).collect())
    assert rows == [("r", 0, 1.0, 2.0, 3.0, 4.0), ("r", 1, 3.0, 4.0, 5.0, 6.0)]


# Filter tree


PATHS = ["a/b/c", "a/b", "a/d", "s/f", "s/f/x", "t", "a/b/e", "s/g/y/z"]


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(p.split("/"),) for p in PATHS] + [(None,)]
    return hierarchy.path_tree(spark.createDataFrame(rows, "filter_paths array<string>"))


def test_tree(tree):
    rows = {r.path: (r.depth, r.parent, r.leaf) for r in tree.collect()}
    assert rows["a"] == (1, None, "a") and rows["s/g/y"] == (3, "s/g", "y")
    assert set(rows) == {"a", "a/b", "a/b/c", "a/b/e", "a/d", "s", "s/f", "s/f/x", "s/g", "s/g/y", "s/g/y/z", "t"}


def test_siblings(tree):
    assert ids(hierarchy.siblings(tree, ["a/b"]), "path") == ["a/d"]
    assert ids(hierarchy.siblings(tree, ["a"]), "path") == []
    assert ids(hierarchy.siblings(tree, ["a/b", "a/d", "s/f"]), "path") == ["a/b", "a/d", "s/g"]
    counts = {r.path: r.siblings for r in hierarchy.sibling_counts(tree).collect()}
    assert counts["a"] == 0 and counts["a/b/c"] == 1 and counts["s/g/y"] == 0


def test_toggle_closure(tree):
    nodes = [r.path for r in tree.collect()]
    children = {n: [m for m in nodes if m.rsplit("/", 1)[0] == n and m != n] for n in nodes}

    def below(node, active):
        out = {node}
        for child in children[node]:
            out |= {m for m in below(child, active) if (m in active) == (node in active)}
        return out

    random.seed(5)
    for _ in range(6):
        active = [n for n in nodes if random.random() < 0.5]
        rows = hierarchy.toggle_closure(tree, active).collect()
        assert {(r.node, r.member) for r in rows} == {(n, m) for n in nodes for m in below(n, active)}
        assert len(rows) == len(set(rows))
    assert ids(hierarchy.toggle_closure(tree, [], "s"), "member") == sorted(below("s", []))


# Map


@pytest.fixture(scope="module")
def points(spark):
    random.seed(2)
    rows = []
    for i in range(400):
        if i % 2:
            lat, lon = random.uniform(-85, 85), random.uniform(-180, 180)
        else:
            lat, lon = 48 + random.uniform(0, 0.01), 2 + random.uniform(0, 0.01)
        rows.append((i, f"l{i}", str(lat), str(lon)))
    rows += [(1000, "same1", "48.5", "2.5"), (1001, "same2", "48.5", "2.5"), (1002, "pole", "90", "0"), (1003, "bad", "91", "0")]
    df = spark.createDataFrame(rows, "location_id int, label string, latitude string, longitude string")
    return spatial.project(df).cache()


def test_every_zoom_counts_every_point_once(points):
    clusters = spatial.cluster(points).cache()
    sums = {r.zoom: r.n for r in clusters.groupBy("zoom").agg(F.sum("point_count").alias("n")).collect()}
    assert sums == {z: 403 for z in range(2, 17)}
    members = spatial.cluster_members(points, 9)
    assert members.count() == members.select("label").distinct().count() == 403
    counted = members.groupBy("zoom", "cell_x", "cell_y").count().collect()
    assert {tuple(r) for r in counted} == {
        tuple(r) for r in clusters.where("zoom = 9").select("zoom", "cell_x", "cell_y", "point_count").collect()
    }
    in_clusters = {r.zoom: r.points_in_clusters for r in spatial.cluster_totals(clusters).collect()}
    assert in_clusters[9] == sum(r["count"] for r in counted if r["count"] > 1)


def test_single_point_is_its_own_centre(points):
    found = spatial.cluster(points, [16]).where("not is_cluster").collect()
    known = {(float(r.latitude), float(r.longitude)) for r in points.collect()}
    assert found and all((r.latitude, r.longitude) in known for r in found)


def test_expansion_zoom_by_counting_cells(points):
    rows = points.select("x", "y").collect()
    def cells(zoom, members):
        side = 30 / (512 * 2**zoom)
        return {(math.floor(p.x / side), math.floor(p.y / side)) for p in members}

    for r in spatial.cluster(points, [2, 6]).where("is_cluster").collect():
        side = 30 / (512 * 2**r.zoom)
        members = [p for p in rows if (math.floor(p.x / side), math.floor(p.y / side)) == (r.cell_x, r.cell_y)]
        first = next((z for z in range(r.zoom + 1, 17) if len(cells(z, members)) > 1), 17)
        assert r.expansion_zoom == first


def test_selected_clusters_and_view(spark, points):
    members = spatial.cluster_members(points, 4)
    selected = spark.createDataFrame([(0,)], "event_key int")
    chosen = links.selected_clusters(members, selected).collect()
    home = members.where("label = 'l0'").collect()[0]
    assert [(r.cell_x, r.cell_y) for r in chosen] == [(home.cell_x, home.cell_y)]
    shown = spatial.clusters_in_view(spatial.cluster(points, [4]), 1, 47, 3, 49, 4).collect()
    assert sum(r.point_count for r in shown) >= 200


# Time


def lanes_by_loop(spans):
    """One span at a time; lanes wait in the order in which they came free."""
    open_spans, free, out, used = [], [], {}, 0
    for key, start, end in sorted(spans, key=lambda s: (s[1], s[0])):
        over = sorted(s for s in open_spans if s[0] < start)
        open_spans = [s for s in open_spans if s[0] >= start]
        free += [lane for *_, lane in over]
        if free:
            lane = free.pop(0)
        else:
            lane, used = used, used + 1
        open_spans.append((end, start, key, lane))
        out[key] = lane
    return out


@pytest.mark.parametrize("seed, width", [(1, 3), (2, 30), (3, 400), (4, 0)])
def test_lanes(spark, many_parts, seed, width):
    random.seed(seed)
    spans = []
    for i in range(300):
        start = random.randrange(1000)
        spans.append((i, minutes(start), minutes(start + random.randrange(width + 1))))
    df = spark.createDataFrame(spans, "first_key int, start timestamp, end timestamp").repartition(4)
    rows = timeline.assign_lanes(df, 16).collect()
    assert {r.first_key: r.lane for r in rows} == lanes_by_loop(spans)
    assert all(r.offset == 16 * r.lane for r in rows)


def test_islands_do_not_overlap(spark, many_parts):
    random.seed(9)
    spans = [(i, s, s + random.randrange(8)) for i, s in enumerate(random.choices(range(3000), k=400))]
    df = spark.createDataFrame(spans, "first_key int, start int, end int")
    rows = timeline.islands(df).groupBy("island").agg(F.min("start").alias("s"), F.max("end").alias("e")).orderBy("s").collect()
    assert len(rows) > 20 and all(a.e < b.s for a, b in zip(rows, rows[1:]))


def test_activity(spark):
    rows = [(minutes(m), t) for m, t in ((0, "a"), (59, "a"), (60, "a"), (61, "b"))]
    df = spark.createDataFrame(rows, "datetime timestamp, track string")
    found = {(r.window_start, r.track): r.events for r in timeline.activity_by_label(df, "1 hour").collect()}
    assert found == {(minutes(0), "a"): 2, (minutes(60), "a"): 1, (minutes(60), "b"): 1}


def test_activity_at_several_widths(spark):
    random.seed(4)
    rows = [(minutes(random.randrange(10_000)), random.choice("ab")) for _ in range(200)]
    df = spark.createDataFrame(rows, "datetime timestamp, track string")
    got = timeline.activity_at(df, [90, 60, 720]).collect()
    for width in (90, 60, 720):
        alone = {tuple(r) for r in timeline.activity(df, width).collect()}
        assert {(r.window_start, r.track, r.events) for r in got if r.minutes == width} == alone


def test_nothing_in_nothing_out(spark):
    spans = spark.createDataFrame([], "first_key int, start timestamp, end timestamp")
    assert timeline.assign_lanes(spans).count() == 0
    points = spark.createDataFrame([], "label string, latitude string, longitude string")
    assert spatial.cluster(spatial.project(points)).count() == 0


def test_saved_view_is_put_in_order():
    view = View.saved((minutes(5), minutes(1)), filters=("a",))
    assert (view.start, view.end, view.filters) == (minutes(1), minutes(5), ("a",))
