"""Points joined to polygons: equi-join on the cells of an adaptive covering, exact test as the residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightings.operators.covering import BASE, cell_of, covering, levels_in_use
from sightings.operators.geo import crosses_right, touches
from sightings.session import staged


def polygon_contains(edges: Column, lat: Column, lon: Column) -> Column:
    """Even-odd rule over a column of edges; points on an edge are inside."""

    inside = F.size(F.filter(edges, lambda e: crosses_right(lon, lat, e["x0"], e["y0"], e["x1"], e["y1"]))) % 2 == 1
    return inside | F.exists(edges, lambda e: touches(lon, lat, e["x0"], e["y0"], e["x1"], e["y1"]))


def join_covering(points: DataFrame, leaves: DataFrame, lat: str, lon: str) -> DataFrame:
    """Inner join of points and the polygons of a covering that contain them.

    A point first meets the table of the levels in use below its cell of the first level: that table has 4096 rows at
    most and is broadcast, and points far from the layer end there.  Its cells at these levels, mostly one or two,
    are then joined by equality: the adaptive planner broadcasts the leaves when their measured size is small, and
    otherwise sorts both sides and splits a cell that holds many points.
    """
    base, levels = "_base", "_levels"
    in_use = levels_in_use(leaves).withColumnsRenamed({"base": base, "levels": levels})
    placed = points.withColumn("_at", cell_of(F.col(lat), F.col(lon), BASE)).join(F.broadcast(in_use), F.col("_at") == F.col(base))
    cells = placed.withColumn("_cell", F.explode(F.transform(levels, lambda level: cell_of(F.col(lat), F.col(lon), level))))
    joined = cells.join(leaves, F.col("_cell") == F.col("cell"))
    return joined.filter(F.col("interior") | polygon_contains(F.col("edges"), F.col(lat), F.col(lon))).drop(
        "_at", base, levels, "_cell", "cell", "level", "interior", "edges")


def join_layer(points: DataFrame, layer: DataFrame, lat: str, lon: str) -> DataFrame:
    """Inner join of points and the polygons of a layer that contain them; the layer's covering is written once."""
    return join_covering(points, staged(covering(layer), "covering"), lat, lon)
