"""Adaptive quadtree covering of a polygon layer: every point meets a bounded number of edges.

The world is cut into cells of level ``BASE``, and a cell into sixteen wherever more than ``edges`` of a polygon's
edges reach into it.  A leaf that no edge reaches is inside the polygon as a whole and needs no test, or is left out.
An edge leaf keeps the edges that meet it.  Another edge passes all points of the leaf on one side; only how many pass
in the east matters, and only whether that number is odd.  It changes at the latitudes where such a chain of edges ends at a kept one; each
of these becomes an edge far in the east.  So the even-odd test over a leaf's own edges gives exactly, bit by bit,
what the test over all edges of the polygon gives.

A covering is made once per layer, a polygon in one task, and can be written as a table and joined again and again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Levels of the cells: 64 by 64 cells at first, 65536 by 65536 at most (600 m at the equator).
BASE, STEP, DEEPEST = 6, 2, 16
# Edges of a polygon that a leaf may keep; with the edges far in the east it holds three times as many and one more.
EDGES = 24
# Edges are compared with cells grown by so much, beyond any rounding of coordinates.
MARGIN = 1e-9
FAR = 1e6

LEAF = T.StructType([
    T.StructField("cell", T.LongType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("interior", T.BooleanType()),
    T.StructField("edges", T.ArrayType(T.StructType([T.StructField(k, T.DoubleType()) for k in ("x0", "y0", "x1", "y1")]))),
])


@dataclass
class _Node:
    level: int
    x: int
    y: int
    kept: np.ndarray  # edges that meet the cell: rows x0, y0, x1, y1
    ends: np.ndarray  # latitudes where an odd number of edges east of the cell end
    odd: bool  # whether an odd number of further ends lie above the cell


def cell_number(level: Column, x: Column, y: Column) -> Column:
    return F.shiftleft(level.cast("bigint"), 58) + F.shiftleft(x.cast("bigint"), 29) + y.cast("bigint")


def _number(level: int, x: int, y: int) -> int:
    return (level << 58) + (x << 29) + y


def cell_of(lat: Column, lon: Column, level: Column | int) -> Column:
    """The cell that a point belongs to; points beyond the world's edge belong to the cells at its edge."""
    level = F.lit(level) if isinstance(level, int) else level
    many = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)

    def place(share: Column) -> Column:
        return F.greatest(F.lit(0).cast("bigint"), F.least(many - 1, F.floor(share * many)))

    return cell_number(level, place((lon + 180) / 360), place((lat + 90) / 180))


def _bounds(level: int, x: int, y: int) -> tuple[float, float, float, float]:
    """West, south, east and north of a cell, grown by the margin; without end at the world's edge."""
    many = 1 << level
    west, east = 360 * x / many - 180 - MARGIN, 360 * (x + 1) / many - 180 + MARGIN
    south, north = 180 * y / many - 90 - MARGIN, 180 * (y + 1) / many - 90 + MARGIN
    return (west if x else -math.inf, south if y else -math.inf, east if x < many - 1 else math.inf, north if y < many - 1 else math.inf)


def _narrowed(node: _Node, level: int, x: int, y: int) -> _Node:
    """The node's part in a cell inside its own."""
    west, south, east, north = _bounds(level, x, y)
    x0, y0, x1, y1 = node.kept.T
    low, high = np.minimum(y0, y1), np.maximum(y0, y1)
    in_band = (high >= south) & (low <= north)
    # where the edge enters and leaves the band; a level edge is in it with all its length
    rise = np.where(y1 == y0, 1.0, y1 - y0)
    at = [np.where(y1 == y0, end, x0 + (x1 - x0) * np.clip((np.clip(bound, low, high) - y0) / rise, 0, 1)) for bound, end in ((south, x0), (north, x1))]
    nearest, farthest = np.minimum(*at), np.maximum(*at)
    meets = in_band & (farthest >= west) & (nearest <= east)
    passed = in_band & (nearest > east)
    ends = np.concatenate([node.ends, y0[passed], y1[passed]])
    odd = node.odd ^ bool((ends > north).sum() % 2)
    values, counts = np.unique(ends[(ends > south) & (ends <= north)], return_counts=True)
    return _Node(level, x, y, node.kept[meets], values[counts % 2 == 1], odd)


def _leaf_edges(node: _Node) -> np.ndarray:
    """Kept edges and edges far in the east that stand for all others; a far edge from an end upwards is passed by
    points at the end or above it, one without end by all."""
    far = [(FAR, end, FAR, FAR) for end in node.ends]
    if node.odd ^ bool(len(far) % 2):
        far.append((FAR, -FAR, FAR, FAR))
    return np.vstack([node.kept, np.array(far).reshape(-1, 4)])


def polygon_leaves(edges: np.ndarray, most: int = EDGES, deepest: int = DEEPEST) -> Iterator[tuple[int, int, bool, np.ndarray | None]]:
    """(cell, level, interior, edges) of the leaves of one polygon, given all its edges."""
    todo = [_Node(0, 0, 0, edges, np.empty(0), False)]
    while todo:
        node = todo.pop()
        if not len(node.kept) and not len(node.ends):
            if node.odd:
                spread = 1 << max(0, BASE - node.level)
                level = max(node.level, BASE)
                for i in range(spread):
                    for j in range(spread):
                        yield _number(level, node.x * spread + i, node.y * spread + j), level, True, None
            continue
        if node.level >= BASE and (len(node.kept) <= most or node.level + STEP > deepest):
            yield _number(node.level, node.x, node.y), node.level, False, _leaf_edges(node)
            continue
        down = STEP if node.level >= BASE else 1
        spread = 1 << down
        todo += [_narrowed(node, node.level + down, node.x * spread + i, node.y * spread + j) for i in range(spread) for j in range(spread)]


def _unwrapped(ring: np.ndarray) -> np.ndarray:
    """The ring with edges of over 180 degrees read as crossing the dateline; one around a pole is closed along it."""
    steps = np.diff(ring[:, 0])
    turn = np.where(steps > 180, -360.0, np.where(steps < -180, 360.0, 0.0))
    out = ring.copy()
    out[1:, 0] += np.cumsum(turn)
    if len(out) and out[-1, 0] != out[0, 0]:
        pole = math.copysign(90.0, out[:, 1].mean())
        out = np.vstack([out, [out[-1, 0], pole], [out[0, 0], pole], out[:1]])
    return out


def ring_edges(rings: Sequence[np.ndarray]) -> np.ndarray:
    """Edges of all rings; of rings over the dateline also those moved by a turn, so that the world is covered."""
    out = [np.empty((0, 4))]
    for ring in rings:
        if len(ring) < 2:
            continue
        ring = _unwrapped(ring)
        own = np.hstack([ring[:-1], ring[1:]])
        low, high = ring[:, 0].min(), ring[:, 0].max()
        out.append(own)
        if low < -180 or high > 180:
            out += [own + [turn, 0, turn, 0] for turn in (-360.0, 360.0) if low + turn < 180 and high + turn > -180]
    return np.vstack(out)


def covering(layer: DataFrame, edges: int = EDGES, deepest: int = DEEPEST) -> DataFrame:
    """The layer's columns but ``ring`` or ``rings``, with (cell, level, interior, edges) for every leaf.

    A ring is an array of structs (x, y), closed; ``rings`` holds one polygon's rings, holes and parts too.  A missing
    ring, and a missing corner in it, count as absent.
    """
    shape = "rings" if "rings" in layer.columns else "ring"
    rest = [f for f in layer.schema if f.name not in ("ring", "rings")]
    own = layer.withColumn("_rings", F.col("rings") if shape == "rings" else F.array("ring")).drop("ring", "rings")
    names = [f.name for f in rest]

    def rings_of(value: Sequence | None) -> list[np.ndarray]:
        rings = [] if value is None else [r for r in value if r is not None]
        return [np.array([(p["x"], p["y"]) for p in r if p is not None and p["x"] is not None and p["y"] is not None], float).reshape(-1, 2) for r in rings]

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                found = list(polygon_leaves(ring_edges(rings_of(row["_rings"])), edges, deepest))
                for begin in range(0, len(found), 10_000):
                    some = found[begin : begin + 10_000]
                    out = pd.DataFrame(
                        [(cell, level, inside, None if e is None else [dict(zip(("x0", "y0", "x1", "y1"), v)) for v in e.tolist()]) for cell, level, inside, e in some],
                        columns=LEAF.names,
                    )
                    for name in names:
                        out[name] = [row[name]] * len(out)
                    yield out[[*names, *LEAF.names]]

    return own.mapInPandas(leaves, T.StructType([*rest, *LEAF.fields]))


def base_cell(cell: Column, level: Column) -> Column:
    """The cell of the first level that holds a deeper one."""
    up = (level - BASE).cast("int")
    x = F.shiftright(cell.bitwiseAND(F.lit((1 << 58) - 1)), 29)
    y = cell.bitwiseAND(F.lit((1 << 29) - 1))
    return cell_number(F.lit(BASE), F.call_function("shiftright", x, up), F.call_function("shiftright", y, up))


def levels_in_use(leaves: DataFrame) -> DataFrame:
    """(base, levels): the levels of the leaves below each cell of the first level; 4096 rows at most."""
    return leaves.groupBy(base_cell(F.col("cell"), F.col("level")).alias("base")).agg(F.collect_set("level").alias("levels"))
