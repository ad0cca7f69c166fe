"""Heatmap pyramid: records counted once at the finest cells, the coarser zooms rolled up from finer ones.

A cell's count, coordinate sums and bounds add up to those of the cell above it, because a geohash is a prefix of its
parts' geohashes.  The records are read once for all zooms.  A box that cuts cells takes whole cells from the
pyramid and counts the records of the cells on its rim, which lie in four narrow strips.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.operators.geo import bounding_box
from sightings.operators.heatmap import DEFAULT_BUCKETS, LENGTH_BY_ZOOM, MIN_CELL_LIMIT, cell_indexes, geohash_text, length_of

_SCHEMA = "x bigint, y bigint, n bigint, sumlat double, sumlon double, top double, bottom double, `left` double, `right` double, length int"
# Lengths rolled up by one shuffle: a cell has at most 32 to that power cells of the finer length.
STEP = 3
# Cells that one task rolls up, about.
TASK_CELLS = 200_000
_MEASURES = {"n": F.sum, "sumlat": F.sum, "sumlon": F.sum, "top": F.max, "bottom": F.min, "left": F.min, "right": F.max}


def _bits(length: int) -> tuple[int, int]:
    return (5 * length + 1) // 2, 5 * length // 2


def _of_records(df: DataFrame, length: int) -> DataFrame:
    lat, lon = F.col("decimallatitude"), F.col("decimallongitude")
    x, y = cell_indexes(lat, lon, length)
    return df.where(F.col("hascoordinate")).groupBy(x.alias("x"), y.alias("y")).agg(
        F.count("*").alias("n"), F.sum(lat).alias("sumlat"), F.sum(lon).alias("sumlon"), F.max(lat).alias("top"), F.min(lat).alias("bottom"),
        F.min(lon).alias("left"), F.max(lon).alias("right"))


class Pyramid:
    """The cells of all geohash lengths at a path, in a folder for each length."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def write(cls, df: DataFrame, path: str, zooms: int = len(LENGTH_BY_ZOOM)) -> Pyramid:
        """One pass over the records; the coarser lengths, ``STEP`` at once, from the cells of the next finer one."""
        pyramid, lengths = cls(df.sparkSession, path), sorted(set(LENGTH_BY_ZOOM[:zooms]), reverse=True)
        world = df.where(bounding_box(F.col("decimallatitude"), F.col("decimallongitude"), -180.0, -90.0, 180.0, 90.0))
        _of_records(world, lengths[0]).write.parquet(f"{pyramid.path}/length={lengths[0]}")
        for k in range(1, len(lengths), STEP):
            pyramid._rolled_up(lengths[k - 1], lengths[k:k + STEP]).write.mode("append").partitionBy("length").parquet(pyramid.path)
        return pyramid

    def _rolled_up(self, finer: int, lengths: list[int]) -> DataFrame:
        """The cells of coarser lengths, shuffled once, by the cell of the coarsest, which has a bounded number of parts."""

        def above(length: int) -> list[Column]:
            (fx, fy), (x, y) = _bits(finer), _bits(length)
            return [F.shiftright("x", fx - x), F.shiftright("y", fy - y)]

        (top_x, top_y), fine = above(lengths[-1]), self.cells(finer).drop("length")
        tasks = max(self.spark.sparkContext.defaultParallelism, math.ceil(fine.count() / TASK_CELLS))
        dealt = fine.withColumns({"_x": top_x, "_y": top_y}).repartition(tasks, "_x", "_y")
        places = [F.struct(F.lit(n).alias("length"), above(n)[0].alias("x"), above(n)[1].alias("y")) for n in lengths]
        up = dealt.select("_x", "_y", *_MEASURES, F.explode(F.array(*places)).alias("cell")).select("_x", "_y", *_MEASURES, "cell.*")
        cells = up.groupBy("_x", "_y", "length", "x", "y").agg(*[merge(F.col(name)).alias(name) for name, merge in _MEASURES.items()])
        return cells.drop("_x", "_y")

    def cells(self, length: int) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(self.path).where(F.col("length") == length)

    def heatmap(self, zoom: int, box: tuple[float, float, float, float] | None = None, records: DataFrame | None = None,
                mode: str = "GEO_BOUNDS", buckets: int = DEFAULT_BUCKETS) -> DataFrame:
        """As ``heatmap.heatmap`` gives it; a box needs the records too, for its rim."""
        length = length_of(zoom)
        cells = self.cells(length).drop("length")
        if box is not None:
            cells = self._in_box(cells, length, box, records)
        if mode == "GEO_BOUNDS":
            shape = [F.col(c) for c in ("top", "left", "bottom", "right")]
        elif mode == "GEO_CENTROID":
            shape = [(F.col("sumlat") / F.col("n")).alias("latitude"), (F.col("sumlon") / F.col("n")).alias("longitude")]
        else:
            raise ValueError(f"unknown heatmap mode {mode}")
        named = cells.select(F.col("n").alias("count"), *shape, geohash_text(F.col("x"), F.col("y"), length).alias("cell"))
        return named.orderBy(F.desc("count"), "cell").limit(max(buckets, MIN_CELL_LIMIT))

    def _in_box(self, cells: DataFrame, length: int, box: tuple[float, float, float, float], records: DataFrame | None) -> DataFrame:
        """Cells inside the box from the pyramid, those that its sides pass through counted anew."""
        if records is None:
            raise ValueError("a box needs the records of its rim")
        left, bottom, right, top = box
        xb, yb = _bits(length)

        def side(value: float, low: float, span: float, bits: int) -> int:
            return min(int((value - low) / span * (1 << bits) // 1), (1 << bits) - 1)

        x0, x1, y0, y1 = side(left, -180.0, 360.0, xb), side(right, -180.0, 360.0, xb), side(bottom, -90.0, 180.0, yb), side(top, -90.0, 180.0, yb)
        x, y = F.col("x"), F.col("y")
        if left <= right:
            inner = (x > x0) & (x < x1)
        else:
            inner = (x > x0) | (x < x1)
        inner = inner & (y > y0) & (y < y1)

        def strip(index: int, low: float, span: float, bits: int, c: Column) -> Column:
            width = span / (1 << bits)
            return c.between(low + (index - 1) * width, low + (index + 2) * width)  # a cell more on each side, for the scan

        lat, lon = F.col("decimallatitude"), F.col("decimallongitude")
        near = [strip(i, -180.0, 360.0, xb, lon) for i in (x0, x1)] + [strip(i, -90.0, 180.0, yb, lat) for i in (y0, y1)]
        rim = _of_records(records.where(bounding_box(lat, lon, *box) & reduce(or_, near)), length)
        on_rim = x.isin(x0, x1) | y.isin(y0, y1)
        return cells.where(inner).unionByName(rim.where(on_rim).select(*cells.columns))
