"""Spatial filters as native column expressions."""

from __future__ import annotations

import json
import math
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightings.operators.shapes import Point, Ring, Shape, parse_wkt

EARTH_RADIUS_M = 6371008.7714

# Metres per unit of a distance text such as "5km".
DISTANCE_UNITS = {
    "mm": 0.001, "cm": 0.01, "m": 1.0, "km": 1000.0, "in": 0.0254, "ft": 0.3048,
    "yd": 0.9144, "mi": 1609.344, "nmi": 1852.0,
}

# Shapes of many edges are cut into bands of latitude, with about this many edges each.
EDGES_PER_BAND, MAX_BANDS = 8, 1024


def parse_distance(text: str) -> float:
    match = re.match(r"^\s*([0-9.]+)\s*([a-zA-Z]*)\s*$", text)
    if match is None or (match.group(2) or "m").lower() not in DISTANCE_UNITS:
        raise ValueError(f"not a distance: {text!r}")
    return float(match.group(1)) * DISTANCE_UNITS[(match.group(2) or "m").lower()]


def in_range(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def bounding_box(lat: Column, lon: Column, left: float, bottom: float, right: float, top: float) -> Column:
    """Plain comparisons, so they reach the scan; a box with left > right wraps."""
    inside = lon.between(left, right) if left <= right else (lon >= left) | (lon <= right)
    return lat.between(bottom, top) & inside


def haversine_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def geo_distance(centre_lat: float, centre_lon: float, distance: str, lat: Column, lon: Column) -> Column:
    """Within the distance of a fixed point; false, never null, without coordinates."""
    metres = parse_distance(distance)
    close = haversine_metres(F.lit(float(centre_lat)), F.lit(float(centre_lon)), lat, lon) <= metres
    reach = math.degrees(metres / EARTH_RADIUS_M) * 1.0001
    box = lat.between(centre_lat - reach, centre_lat + reach)
    if abs(centre_lat) + reach < 89:
        # widest longitude reach of the circle
        wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(centre_lat)))))
        if centre_lon - wide >= -180 and centre_lon + wide <= 180:
            box = box & lon.between(centre_lon - wide * 1.0001, centre_lon + wide * 1.0001)
    return F.coalesce(box & close, F.lit(False))


Edge = tuple[float, float, float, float]


def _edges(rings: list[Ring]) -> list[Edge]:
    return [(*a, *b) for ring in rings for a, b in zip(ring, ring[1:])]


def crosses_right(x: Column, y: Column, x0, y0, x1, y1) -> Column:
    """The edge passes to the right of the point on its way over the point's latitude."""
    spans = (y0 > y) != (y1 > y)
    # a horizontal edge spans no latitude; try_divide keeps its slope from failing
    return spans & (x < F.try_divide((x1 - x0) * (y - y0), y1 - y0) + x0)


def touches(x: Column, y: Column, x0, y0, x1, y1) -> Column:
    on_line = (x1 - x0) * (y - y0) == (y1 - y0) * (x - x0)
    return on_line & x.between(F.least(x0, x1), F.greatest(x0, x1)) & y.between(F.least(y0, y1), F.greatest(y0, y1))


_EDGE = "struct<x0:double,y0:double,x1:double,y1:double>"


def _literal(value: list, ddl: str) -> Column:
    """A nested literal; the text is parsed once, when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def _rows(edges: list[Edge]) -> list[dict[str, float]]:
    return [{"x0": x0, "y0": y0, "x1": x1, "y1": y1} for x0, y0, x1, y1 in edges]


def _near_edges(lat: Column, edges: list[Edge]) -> Column:
    """The edges that can matter for a latitude: those of its band, for shapes of many edges.

    A point is compared with the edges whose latitudes span its own, a few of
    thousands; an edge is listed in every band it passes through.
    """
    bottom = min(min(e[1], e[3]) for e in edges)
    height = max(max(e[1], e[3]) for e in edges) - bottom
    bands = min(MAX_BANDS, len(edges) // EDGES_PER_BAND)
    if bands < 2 or height == 0:
        return _literal(_rows(edges), f"array<{_EDGE}>")
    step = height / bands

    def band(y: float) -> int:
        return max(0, min(bands - 1, math.floor((y - bottom) / step)))

    listed: list[list[Edge]] = [[] for _ in range(bands)]
    for edge in edges:
        for n in range(band(min(edge[1], edge[3])), band(max(edge[1], edge[3])) + 1):
            listed[n].append(edge)
    place = F.greatest(F.lit(0), F.least(F.lit(bands - 1), F.floor((lat - bottom) / step).cast("int")))
    return F.get(_literal([_rows(b) for b in listed], f"array<array<{_EDGE}>>"), place)


def _meets(lat: Column, lon: Column, edges: list[Edge], closed: bool) -> Column:
    """On an edge or, for closed rings, inside by the even-odd rule.

    The point and its edges are bound once as lambda variables: the expression keeps
    its size however many vertices the shape has.
    """

    def test(p: Column) -> Column:
        near = p["edges"]
        touching = F.exists(near, lambda e: touches(p["x"], p["y"], e["x0"], e["y0"], e["x1"], e["y1"]))
        if not closed:
            return touching
        crossed = F.filter(near, lambda e: crosses_right(p["x"], p["y"], e["x0"], e["y0"], e["x1"], e["y1"]))
        return (F.size(crossed) % 2 == 1) | touching

    point = F.struct(lon.alias("x"), lat.alias("y"), _near_edges(lat, edges).alias("edges"))
    return F.exists(F.array(point), test)


def _in_polygon(lat: Column, lon: Column, rings: list[Ring]) -> Column:
    """Box test first, then the exact one; a ring over the dateline is tried shifted too."""
    edges = _edges(rings)
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    tests = []
    for shift in (0.0, 360.0, -360.0):
        if max(xs) < -180 + shift or min(xs) > 180 + shift:
            continue
        if shift and -180 <= min(xs) and max(xs) <= 180:
            continue
        box = lat.between(min(ys), max(ys)) & lon.between(min(xs) - shift, max(xs) - shift)
        tests.append(box & _meets(lat, lon + shift if shift else lon, edges, closed=True))
    return reduce(or_, tests)


def shape_contains(shape: Shape, lat: Column, lon: Column) -> Column:
    tests = [(lon == x) & (lat == y) for x, y in shape.points]
    tests += [_meets(lat, lon, _edges([line]), closed=False) for line in shape.lines]
    tests += [_in_polygon(lat, lon, rings) for rings in shape.polygons]
    tests += [bounding_box(lat, lon, left, bottom, right, top) for left, right, bottom, top in shape.wrapped]
    return F.coalesce(in_range(lat, lon) & reduce(or_, tests), F.lit(False))


def within(wkt: str, lat: Column, lon: Column) -> Column:
    """The point meets the shape, edge included; false on null or out-of-range input."""
    return shape_contains(parse_wkt(wkt), lat, lon)


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests)


def all_of(tests: list[Column]) -> Column:
    return reduce(and_, tests)


__all__ = [
    "Point", "all_of", "any_of", "bounding_box", "geo_distance", "haversine_metres", "in_range",
    "parse_distance", "shape_contains", "within",
]
