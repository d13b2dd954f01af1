"""Map clusters on a grid that halves with each zoom.

A cell of one zoom lies wholly inside a cell of the zoom before, so each zoom can be
added up from the finest one.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from eventscope import fixed_values as fixed
from eventscope.functions.predicates import in_box
from eventscope.functions.values import has_valid_coordinates, to_number

ZOOMS = range(fixed.MIN_ZOOM, fixed.MAX_ZOOM + 1)


def project(df: DataFrame, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """Coordinates as numbers ``lat`` and ``lon``, and Web-Mercator ``x`` and ``y`` in [0, 1];
    rows without valid coordinates go."""
    lat, lon = to_number(latitude), to_number(longitude)
    sine = F.sin(lat * F.pi() / 180)
    y = 0.5 - 0.25 * F.ln((1 + sine) / (1 - sine)) / F.pi()
    # The poles are at infinity; they go to the edge.
    edge = F.when(lat >= 90, 0.0).when(lat <= -90, 1.0)
    return df.where(has_valid_coordinates(latitude, longitude)).withColumns({
        "lat": lat,
        "lon": lon,
        "x": lon / 360 + 0.5,
        "y": F.coalesce(edge, F.greatest(F.lit(0.0), F.least(F.lit(1.0), y))),
    })


def latitude_of(y: Column) -> Column:
    """Degrees of a Web-Mercator ``y``."""
    return F.atan(F.exp((1 - y * 2) * F.pi())) * 360 / F.pi() - 90


def cell(coordinate: str, zoom: int, radius: int = fixed.CLUSTER_RADIUS) -> Column:
    return F.floor(F.col(coordinate) * F.lit(fixed.TILE_SIZE * 2**zoom / radius)).cast("long")


def with_cell(points: DataFrame, zoom: int, radius: int = fixed.CLUSTER_RADIUS) -> DataFrame:
    return points.withColumns({
        "zoom": F.lit(zoom), "cell_x": cell("x", zoom, radius), "cell_y": cell("y", zoom, radius)
    })


def cluster(
    points: DataFrame,
    zooms: Sequence[int] = ZOOMS,
    radius: int = fixed.CLUSTER_RADIUS,
    max_zoom: int = fixed.MAX_ZOOM,
) -> DataFrame:
    """Clusters at each zoom: point count, centre, and the zoom at which they fall apart.

    Points are grouped once, at the finest zoom; the coarser ones are added up from those
    cells. A cell with one point is that point (``is_cluster`` is false).
    """
    finest = (
        with_cell(points, max_zoom, radius)
        .groupBy("cell_x", "cell_y")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
            F.min("lat").alias("lat"), F.min("lon").alias("lon"),
        )
    )
    if any(not 0 <= z <= max_zoom for z in zooms):
        raise ValueError(f"zooms must be from 0 to {max_zoom}")
    zoom = F.explode(F.array(*[F.lit(z) for z in zooms])).alias("zoom")
    up = F.lit(max_zoom) - F.col("zoom")
    spread = (
        finest.select("*", zoom)
        .withColumnsRenamed({"cell_x": "fx", "cell_y": "fy"})
        .withColumns({"cell_x": _coarser("fx", up), "cell_y": _coarser("fy", up)})
    )
    groups = spread.groupBy("zoom", "cell_x", "cell_y").agg(
        F.sum("n").alias("point_count"),
        F.sum("sx").alias("sx"),
        F.sum("sy").alias("sy"),
        F.min("lat").alias("lat"),
        F.min("lon").alias("lon"),
        *[f(c).alias(f"{name}_{c}") for name, f in (("min", F.min), ("max", F.max)) for c in ("fx", "fy")],
    )
    many = F.col("point_count") > 1
    x, y = F.col("sx") / F.col("point_count"), F.col("sy") / F.col("point_count")
    return groups.select(
        "zoom",
        "cell_x",
        "cell_y",
        "point_count",
        many.alias("is_cluster"),
        F.when(many, (x - 0.5) * 360).otherwise(F.col("lon")).alias("longitude"),
        F.when(many, latitude_of(y)).otherwise(F.col("lat")).alias("latitude"),
        _expansion_zoom(max_zoom).alias("expansion_zoom"),
    )


def _coarser(place: str, steps: Column) -> Column:
    return F.call_function("shiftright", F.col(place), steps)


def _expansion_zoom(max_zoom: int) -> Column:
    """First zoom at which the finest cells of a cluster are not all in one cell: that of
    the highest bit in which their places differ. Past the last zoom, points stand alone."""
    differing = F.col("min_fx").bitwiseXOR(F.col("max_fx")).bitwiseOR(
        F.col("min_fy").bitwiseXOR(F.col("max_fy"))
    )
    return F.when(differing == 0, max_zoom + 1).otherwise(max_zoom + 1 - F.length(F.bin(differing)))


def zoom_to_fly(expansion_zoom="expansion_zoom", min_zoom=fixed.MIN_ZOOM, max_zoom=fixed.MAX_ZOOM) -> Column:
    """Zoom the view flies to when a cluster is opened."""
    return F.greatest(
        F.greatest(F.col(expansion_zoom), F.lit(min_zoom)) + fixed.ZOOM_STEPS_TO_FLY, F.lit(max_zoom)
    )


def cluster_totals(clusters: DataFrame) -> DataFrame:
    """Points that are in clusters, per zoom; single points do not count."""
    return clusters.groupBy("zoom").agg(
        F.sum(F.when(F.col("is_cluster"), F.col("point_count")).otherwise(0)).alias("points_in_clusters")
    )


def cluster_members(points: DataFrame, zoom: int, radius: int = fixed.CLUSTER_RADIUS) -> DataFrame:
    """Locations with the cell they are in at a zoom: join clusters on zoom and cell."""
    return with_cell(points, zoom, radius)


def clusters_in_view(clusters: DataFrame, west, south, east, north, zoom: int) -> DataFrame:
    return clusters.where((F.col("zoom") == zoom) & in_box(west, south, east, north))
