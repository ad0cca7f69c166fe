"""WKT literals, parsed once in the driver into rings of coordinates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

Point = tuple[float, float]
Ring = list[Point]


@dataclass
class Shape:
    """Points, lines and polygons (outer ring first, then holes) in lon/lat order."""

    points: list[Point] = field(default_factory=list)
    lines: list[Ring] = field(default_factory=list)
    polygons: list[list[Ring]] = field(default_factory=list)
    # lon ranges of clockwise rectangles, read as crossing the dateline
    wrapped: list[tuple[float, float, float, float]] = field(default_factory=list)


def _coordinates(text: str) -> Ring:
    ring = []
    for pair in text.split(","):
        numbers = pair.split()
        if len(numbers) < 2:
            raise ValueError(f"bad coordinate {pair!r}")
        point = (float(numbers[0]), float(numbers[1]))
        if not ring or ring[-1] != point:
            ring.append(point)
    return ring


def _rings(text: str) -> list[Ring]:
    return [_coordinates(r) for r in re.findall(r"\(([^()]+)\)", text)]


def _unwrapped(ring: Ring) -> Ring:
    """An edge spanning more than 180 degrees is read as crossing the dateline."""
    out, shift = [ring[0]], 0.0
    for (x0, _), (x1, y1) in zip(ring, ring[1:]):
        if x1 - x0 > 180:
            shift -= 360
        elif x0 - x1 > 180:
            shift += 360
        out.append((x1 + shift, y1))
    return out


def _signed_area(ring: Ring) -> float:
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:])) / 2


def _is_rectangle(ring: Ring) -> bool:
    if len(ring) != 5 or ring[0] != ring[-1]:
        return False
    return all((x0 == x1) != (y0 == y1) for (x0, y0), (x1, y1) in zip(ring, ring[1:]))


def _add_polygon(shape: Shape, rings: list[Ring]) -> None:
    for ring in rings:
        if len(ring) < 4 or ring[0] != ring[-1]:
            raise ValueError("a ring needs at least four points and must close")
    outer = rings[0]
    if len(rings) == 1 and _is_rectangle(outer) and _signed_area(outer) < 0:
        xs, ys = [p[0] for p in outer], [p[1] for p in outer]
        shape.wrapped.append((max(xs), min(xs), min(ys), max(ys)))
    else:
        shape.polygons.append([_unwrapped(r) for r in rings])


def parse_wkt(wkt: str) -> Shape:
    match = re.match(r"^\s*([A-Za-z]+)\s*(\(.*\))\s*$", wkt, re.S)
    if match is None:
        raise ValueError(f"not WKT: {wkt!r}")
    kind, body = match.group(1).upper(), match.group(2)
    shape = Shape()
    if kind == "POINT":
        shape.points = _rings(body)[0]
    elif kind == "MULTIPOINT":
        shape.points = [p for r in re.findall(r"[^(),]+", body) if r.strip() for p in _coordinates(r)]
    elif kind == "LINESTRING":
        shape.lines = _rings(body)
    elif kind == "MULTILINESTRING":
        shape.lines = _rings(body)
    elif kind == "POLYGON":
        _add_polygon(shape, _rings(body))
    elif kind == "MULTIPOLYGON":
        for polygon in re.findall(r"\(\s*(?:\([^()]+\)\s*,?\s*)+\)", body[1:-1]):
            _add_polygon(shape, _rings(polygon))
    else:
        raise ValueError(f"shape {kind} is not supported")
    return shape
