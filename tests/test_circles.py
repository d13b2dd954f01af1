import random
from collections import defaultdict

import pytest

from eventscope.operators import circles


def by_loop(points, radius):
    """Greedy, one point at a time: ``{key: centre}``."""
    taken = {}
    for key in sorted(points):
        if key in taken:
            continue
        x, y = points[key][:2]
        for other in sorted(points):
            if other not in taken and (points[other][0] - x) ** 2 + (points[other][1] - y) ** 2 <= radius * radius:
                taken[other] = key
    return taken


def levels_by_loop(points, max_zoom, radius=30):
    """``{zoom: {key: (x, y, n)}}`` and ``{zoom: {point: cluster}}``."""
    level = {k: (x, y, 1) for k, (x, y) in points.items()}
    shown, members, where = {}, {}, {k: k for k in points}
    for zoom in range(max_zoom, -1, -1):
        taken = by_loop(level, radius / (512 * 2**zoom))
        groups = defaultdict(list)
        for key, centre in taken.items():
            groups[centre].append(level[key])
        level = {}
        for centre, parts in groups.items():
            n = sum(p[2] for p in parts)
            level[centre] = (sum(p[0] * p[2] for p in parts) / n, sum(p[1] * p[2] for p in parts) / n, n)
        where = {k: taken[c] for k, c in where.items()}
        shown[zoom], members[zoom] = dict(level), dict(where)
    return shown, members


@pytest.mark.parametrize("seed, spread", [(1, 0.01), (2, 0.3)])
def test_one_level(spark, seed, spread):
    random.seed(seed)
    points = {k: (0.5 + spread * random.random(), 0.5 + spread * random.random()) for k in random.sample(range(9999), 400)}
    points[10_000] = points[10_001] = (0.5, 0.5)
    radius = 0.03
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in points.items()], "k int, x double, y double")
    centres, rounds = circles.greedy_centres(circles._cells(df, radius), radius)
    assert {r.k for r in centres.collect()} == set(by_loop(points, radius).values())
    assert rounds <= 10


def test_keys_that_rise_along_a_line(spark):
    """The longest chain there can be: every centre waits for the one before it."""
    points = {k: (0.1 + 0.008 * k, 0.5) for k in range(12)}
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in points.items()], "k int, x double, y double")
    centres, rounds = circles.greedy_centres(circles._cells(df, 0.01), 0.01)
    assert sorted(r.k for r in centres.collect()) == [0, 2, 4, 6, 8, 10] and rounds == 6


def test_all_zooms(spark):
    random.seed(3)
    points = {k: (random.random(), random.random()) for k in range(150)}
    for k in range(150, 200):
        points[k] = (0.3 + random.random() / 300, 0.6 + random.random() / 300)
    for k in range(200, 240):
        points[k] = points[7]
    shown, members = levels_by_loop(points, 3)
    rows = [(k, x, y, float(k), -float(k)) for k, (x, y) in points.items()]
    df = spark.createDataFrame(rows, "label int, x double, y double, lat double, lon double").repartition(3)
    found = circles.circle_clusters(df, max_zoom=3)
    rows = found.clusters.collect()
    for zoom in range(4):
        here = {r.label: r for r in rows if r.zoom == zoom}
        assert {k: r.point_count for k, r in here.items()} == {k: n for k, (_, _, n) in shown[zoom].items()}
        for k, r in here.items():
            if r.point_count > 1:
                assert r.longitude == pytest.approx((shown[zoom][k][0] - 0.5) * 360, abs=1e-9)
            else:
                assert (r.latitude, r.longitude) == (k, -k)
            assert r.is_cluster == (r.point_count > 1) and (r.expansion_zoom is None) == (r.point_count == 1)
        at = circles.circle_members(found, zoom, max_zoom=3).collect()
        assert {r.label: r.cluster for r in at} == members[zoom]
    # A cluster falls apart at the first zoom at which its members are in several.
    for r in rows:
        if r.is_cluster and r.expansion_zoom <= 3:
            mine = {k for k, c in members[r.zoom].items() if c == r.label}
            assert len({members[r.expansion_zoom][k] for k in mine}) > 1
            assert len({members[r.expansion_zoom - 1][k] for k in mine}) == 1


def test_no_points(spark):
    df = spark.createDataFrame([], "label string, x double, y double, lat double, lon double")
    found = circles.circle_clusters(df, max_zoom=1)
    assert found.clusters.isEmpty() and found.parents.isEmpty()
