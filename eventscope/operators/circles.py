"""Map clusters as circles: at each zoom, points in a fixed order take all that is left
within a radius of them.

Taken one by one: a point that no earlier one took is a centre and takes what is near and
left. The centres are thus the points with no centre before them within the radius, and
each other point goes to its first centre. Rounds find them over all tasks: a point that
has the least key of all undecided points near it is a centre, whatever the others become.
Space is cut into cells in which all points are near each other, so a cell has at most one
centre, and only its least undecided point is asked for. A point meets the candidates of
25 cells, however many points these hold.

Zooms go from fine to coarse; the clusters of one are the points of the next.
"""

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from eventscope import fixed_values as fixed
from eventscope.operators.spatial import latitude_of
from eventscope.session import use_checkpoint_folder

# A cell's side as a part of the radius: its diagonal stays under the radius, and two cells
# to each side hold all that is near.
SIDE, REACH = 2 / 3, 2


class Circles(NamedTuple):
    """``clusters`` has a row per zoom and cluster, named by its centre's key; ``parents``
    says which cluster takes each cluster of the zoom before (of the finest: each point)."""

    clusters: DataFrame
    parents: DataFrame


def _saved(df: DataFrame) -> DataFrame:
    use_checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def _cells(points: DataFrame, radius: float) -> DataFrame:
    return points.withColumns({
        f"c{axis}": F.floor(F.col(axis) / (radius * SIDE)).cast("long") for axis in ("x", "y")
    })


def _around(rows: DataFrame) -> DataFrame:
    """``rows`` (k, x, y, cx, cy) once for each cell that holds points near them."""
    steps = F.sequence(F.lit(-REACH), F.lit(REACH))
    return rows.select(
        F.col("k").alias("hk"), F.col("x").alias("hx"), F.col("y").alias("hy"), "cy",
        F.explode(F.transform(steps, lambda d: F.col("cx") + d)).alias("cx"),
    ).withColumn("cy", F.explode(F.transform(steps, lambda d: F.col("cy") + d)))


def _is_near(radius: float) -> Column:
    dx, dy = F.col("x") - F.col("hx"), F.col("y") - F.col("hy")
    return dx * dx + dy * dy <= F.lit(radius * radius)


def greedy_centres(points: DataFrame, radius: float) -> tuple[DataFrame, int]:
    """Centres among ``points`` (k, x, y, cx, cy; keys unlike) and the rounds it took. Rounds
    follow the longest chain of near points whose keys rise; with keys that do not follow
    the map, that grows with the logarithm of the points. Each is saved."""
    left, found, rounds = _saved(points.select("k", "x", "y", "cx", "cy")), [], 0
    while not left.isEmpty():
        least = left.groupBy("cx", "cy").agg(F.min_by(F.struct("k", "x", "y"), "k").alias("p"))
        heads = least.select("p.*", "cx", "cy")
        met = left.join(_around(heads), ["cx", "cy"]).where(_is_near(radius))
        taken = met.where(F.col("k") < F.col("hk")).select(F.col("hk").alias("k")).distinct()
        centres = _saved(heads.join(taken, "k", "left_anti").select("k", "x", "y", "cx", "cy"))
        near = left.join(_around(centres), ["cx", "cy"]).where(_is_near(radius)).select("k").distinct()
        left = _saved(left.join(near, "k", "left_anti"))
        found.append(centres)
        rounds += 1
    return (reduce(DataFrame.unionByName, found) if found else left), rounds


def _level(points: DataFrame, zoom: int, radius: float) -> tuple[DataFrame, DataFrame]:
    """Clusters of one zoom (k, x, y, n, origin, lat, lon) and the cluster that each point goes
    to. ``lat`` and ``lon`` are those of the centre."""
    celled = _cells(points, radius)
    centres, _ = greedy_centres(celled, radius)
    first = _saved(
        celled.join(_around(centres), ["cx", "cy"]).where(_is_near(radius))
        .groupBy("k", "x", "y", "n", "origin", "lat", "lon").agg(F.min("hk").alias("parent"))
    )
    total = F.sum("n")
    # A cluster that takes nothing more stays as it is.
    alone = F.count(F.lit(1)) == 1
    clusters = first.groupBy(F.col("parent").alias("k")).agg(
        *[F.when(alone, F.min(c)).otherwise(F.sum(F.col(c) * F.col("n")) / total).alias(c) for c in ("x", "y")],
        total.alias("n"),
        F.when(alone, F.min("origin")).otherwise(F.lit(zoom)).alias("origin"),
        *[F.min_by(c, "k").alias(c) for c in ("lat", "lon")],
    )
    return _saved(clusters), first.select("k", "parent")


def circle_clusters(
    points: DataFrame,
    key: str = "label",
    min_zoom: int = 0,
    max_zoom: int = fixed.MAX_ZOOM,
    radius: int = fixed.CLUSTER_RADIUS,
) -> Circles:
    """Clusters at each zoom from ``max_zoom`` down to ``min_zoom``, in order of ``key``, which
    no two points share: key of the centre, point count, centre of mass (a single point's own
    coordinates), and the zoom at which the cluster falls apart.

    ``points`` has ``x``, ``y``, ``lat`` and ``lon`` (``spatial.project``). Points at one place are one point
    from the start, so a place may hold any share of the rows.
    """
    reach = [radius / (fixed.TILE_SIZE * 2**zoom) for zoom in range(max_zoom + 1)]
    rows = _saved(points.select(F.col(key).alias("k"), "x", "y", "lat", "lon"))
    level = rows.groupBy("x", "y").agg(
        F.min("k").alias("k"), F.count(F.lit(1)).alias("n"),
        *[F.min_by(c, "k").alias(c) for c in ("lat", "lon")],
    ).withColumn("origin", F.when(F.col("n") > 1, max_zoom))
    places = level.select("x", "y", F.col("k").alias("place"))
    clusters, parents = [], []
    for zoom in range(max_zoom, min_zoom - 1, -1):
        level, taken = _level(level, zoom, reach[zoom])
        if zoom == max_zoom:
            of_place = taken.withColumnRenamed("k", "place")
            taken = rows.select("k", "x", "y").join(places, ["x", "y"]).join(of_place, "place").select("k", "parent")
        clusters.append(level.withColumn("zoom", F.lit(zoom)))
        parents.append(taken.withColumn("zoom", F.lit(zoom)))
    many = F.col("n") > 1
    shown = reduce(DataFrame.unionByName, clusters).select(
        "zoom", F.col("k").alias(key), F.col("n").alias("point_count"), many.alias("is_cluster"),
        F.when(many, (F.col("x") - 0.5) * 360).otherwise(F.col("lon")).alias("longitude"),
        F.when(many, latitude_of(F.col("y"))).otherwise(F.col("lat")).alias("latitude"),
        F.when(many, F.col("origin") + 1).alias("expansion_zoom"),
    )
    links = reduce(DataFrame.unionByName, parents).select("zoom", F.col("k").alias(key), "parent")
    return Circles(shown, links)


def circle_members(circles: Circles, zoom: int, max_zoom: int = fixed.MAX_ZOOM, key: str = "label") -> DataFrame:
    """Each point's key with the ``cluster`` it is in at a zoom: parents, level by level."""
    found = circles.parents.where(F.col("zoom") == max_zoom).select(key, F.col("parent").alias("cluster"))
    for level in range(max_zoom - 1, zoom - 1, -1):
        up = circles.parents.where(F.col("zoom") == level).select(F.col(key).alias("cluster"), "parent")
        found = found.join(up, "cluster").select(key, F.col("parent").alias("cluster"))
    return found
