"""Tables clustered along a Hilbert curve, and shapes as ranges of it.

Places close to each other stand close on the curve, and every quadtree cell is one range of it.  A table sorted by the
curve's number has files and row groups of small areas; a list of the files with their ranges stands beside it.  A
shape is covered by cells, its ranges pick the files and reach their scan as comparisons, and the exact test follows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.operators import geo
from sightings.operators.covering import _narrowed, _Node
from sightings.operators.shapes import Ring, Shape, parse_wkt
from sightings.operators.tree_intervals import in_ranges, merged

# Levels of the curve: 65536 by 65536 cells, numbers of 32 bits.
ORDER = 16
# Ranges of a shape at most, and cells that are cut further until there are so many.
RANGES, CELLS = 64, 400
PLACE = "placekey"
# Levels of the curve that a point goes down by one look at a list.
LEVELS = 4


@lru_cache
def _steps(levels: int) -> list[int]:
    """The curve's steps through so many levels at once.

    At state, bits of x, bits of y: the number on those levels, and above its bits the state in which the next ones are
    read.  A state tells whether the axes have changed places (1) and whether both are mirrored (2).
    """
    out = []
    for state in range(4):
        for bits in range(1 << 2 * levels):
            x, y, after, d = bits >> levels, bits & ((1 << levels) - 1), state, 0
            for k in reversed(range(levels)):
                right, upper = x >> k & 1, y >> k & 1
                if after & 1:
                    right, upper = upper, right
                if after & 2:
                    right, upper = 1 - right, 1 - upper
                d = d * 4 + ((2 if upper else 3) if right else upper)
                # the lower quarters are turned: mirrored on the right, and their axes change places
                if not upper:
                    after = (after ^ 2 if right else after) ^ 1
            out.append(after << 2 * levels | d)
    return out


def curve_number(lat: Column, lon: Column, order: int = ORDER) -> Column:
    """A point's number on the curve; null without coordinates in range."""
    many = 1 << order

    def index(share: Column) -> Column:
        return F.least(F.floor(share * many), F.lit(many - 1)).cast("bigint")

    x, y = index((lon + 180) / 360), index((lat + 90) / 180)
    number, state, left = F.lit(0).cast("bigint"), F.lit(0), order
    while left:
        levels = left % LEVELS or LEVELS
        left -= levels
        part = (1 << levels) - 1
        bits = F.shiftleft(F.shiftright(x, left).bitwiseAND(part), levels) + F.shiftright(y, left).bitwiseAND(part)
        step = F.get(F.lit(_steps(levels)), F.shiftleft(state, 2 * levels) + bits.cast("int"))
        number = F.shiftleft(number, 2 * levels) + step.bitwiseAND((1 << 2 * levels) - 1)
        state = F.shiftright(step, 2 * levels)
    return F.when(geo.in_range(lat, lon), number)


def cell_number(level: int, x: int, y: int) -> int:
    """The number of a cell on the curve of its level."""
    many, d = 1 << level, 0
    for k in reversed(range(level)):
        right, upper = x >> k & 1, y >> k & 1
        d = d * 4 + (2 if upper else 3) if right else d * 4 + upper
        if not upper:
            if right:
                x, y = many - 1 - x, many - 1 - y
            x, y = y, x
    return d


def _parts(shape: Shape) -> list[np.ndarray]:
    """Edges of each part of a shape, with those over the dateline moved by a turn as well."""

    def edges(rings: list[Ring]) -> np.ndarray:
        own = np.array([(*a, *b) for ring in rings for a, b in zip(ring, ring[1:])], float).reshape(-1, 4)
        turns = [own + [turn, 0, turn, 0] for turn in (-360.0, 360.0) if own[:, ::2].min() < -180 or own[:, ::2].max() > 180]
        return np.vstack([own, *turns])

    def box(left: float, bottom: float, right: float, top: float) -> list[np.ndarray]:
        if left > right:
            return [*box(left, bottom, 180.0, top), *box(-180.0, bottom, right, top)]
        return [edges([[(left, bottom), (right, bottom), (right, top), (left, top), (left, bottom)]])]

    out = [np.array([(x, y, x, y)], float) for x, y in shape.points]
    out += [edges([line]) if len(line) > 1 else np.array([[*line[0], *line[0]]], float) for line in shape.lines]
    out += [edges(rings) for rings in shape.polygons]
    for left, right, bottom, top in shape.wrapped:
        out += box(left, bottom, right, top)
    return out


def shape_ranges(shape: Shape, order: int = ORDER, most: int = RANGES, cells: int = CELLS) -> list[tuple[int, int]]:
    """At most so many ranges of the curve that hold every point of the shape."""
    ranges: list[tuple[int, int]] = []
    parts = _parts(shape)
    for edges in parts:
        level, open_cells, sure = 0, [_Node(0, 0, 0, edges, np.empty(0), False)], []
        while open_cells and level < order and len(open_cells) + len(sure) < cells / len(parts):
            level, cut = level + 1, []
            for node in open_cells:
                for i in (0, 1):
                    for j in (0, 1):
                        part = _narrowed(node, level, 2 * node.x + i, 2 * node.y + j)
                        if len(part.kept):
                            cut.append(part)
                        elif part.odd or len(part.ends):
                            sure.append(part)
            open_cells = cut
        for node in open_cells + sure:
            d, down = cell_number(node.level, node.x, node.y), 2 * (order - node.level)
            ranges.append((d << down, ((d + 1) << down) - 1))
    ranges = merged(ranges)
    if len(ranges) > most:  # the smallest gaps are taken in
        gaps = sorted(range(1, len(ranges)), key=lambda k: ranges[k][0] - ranges[k - 1][1])[: len(ranges) - most]
        for k in sorted(gaps, reverse=True):
            ranges[k - 1 : k + 1] = [(ranges[k - 1][0], ranges[k][1])]
    return ranges


def box_ranges(left: float, bottom: float, right: float, top: float, **more: int) -> list[tuple[int, int]]:
    return shape_ranges(Shape(wrapped=[(left, right, bottom, top)]), **more)


class ClusteredTable:
    """A Parquet table in the curve's order, with the list of its files and their ranges."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def write(cls, df: DataFrame, path: str, lat: str = "decimallatitude", lon: str = "decimallongitude", files: int | None = None, spread: str | None = None) -> ClusteredTable:
        """Writes df with its curve number; rows of one place, which may be very many, are cut by another column's hash."""
        files = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keyed = df.withColumn(PLACE, curve_number(F.col(lat), F.col(lon)))
        keys = [F.col(PLACE), F.xxhash64(spread)] if spread else [F.col(PLACE)]
        keyed.repartitionByRange(files, *keys).sortWithinPartitions(PLACE).write.parquet(f"{path}/rows")
        table = cls(df.sparkSession, path)
        of_file = table.all().select(F.col("_metadata.file_path").alias("file"), PLACE).groupBy("file")
        of_file.agg(F.min(PLACE).alias("low"), F.max(PLACE).alias("high"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/files")
        return table

    def all(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def files(self) -> DataFrame:
        return self.spark.read.schema("file string, low bigint, high bigint, n bigint").parquet(f"{self.path}/files")

    def near(self, ranges: Sequence[tuple[int, int]]) -> DataFrame:
        """Rows of the files that meet the ranges, filtered by them at the scan."""
        meets = F.exists(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ranges]), lambda r: (F.col("low") <= r["b"]) & (F.col("high") >= r["a"]))
        found = [r.file for r in self.files().where(meets if ranges else F.lit(False)).select("file").collect()]  # a row a file
        if not found:
            return self.all().where(F.lit(False))
        return self.spark.read.schema(self.all().schema).parquet(*found).where(in_ranges(F.col(PLACE), ranges))

    def within(self, wkt: str, lat: str = "decimallatitude", lon: str = "decimallongitude") -> DataFrame:
        return self.near(shape_ranges(parse_wkt(wkt))).where(geo.within(wkt, F.col(lat), F.col(lon))).drop(PLACE)

    def box(self, left: float, bottom: float, right: float, top: float, lat: str = "decimallatitude", lon: str = "decimallongitude") -> DataFrame:
        return self.near(box_ranges(left, bottom, right, top)).where(geo.bounding_box(F.col(lat), F.col(lon), left, bottom, right, top)).drop(PLACE)


__all__ = ["ClusteredTable", "box_ranges", "cell_number", "curve_number", "shape_ranges"]
