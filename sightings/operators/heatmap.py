"""Heatmaps: records counted per geohash cell of a zoom level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightings.operators.geo import bounding_box

# Geohash length per zoom level, the alphabet, and the cell limits.
LENGTH_BY_ZOOM = (2, 3, 3, 3, 4, 4, 4, 5, 5, 5, 6, 6, 7, 7, 8, 8, 9, 9, 10)
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
DEFAULT_BUCKETS = 15_000
MIN_CELL_LIMIT = 50_000


def length_of(zoom: int) -> int:
    return LENGTH_BY_ZOOM[min(zoom, len(LENGTH_BY_ZOOM) - 1)]


def _index(c: Column, low: float, span: float, bits: int) -> Column:
    place = F.floor((c - low) / span * float(1 << bits)).cast("bigint")
    return F.least(place, F.lit((1 << bits) - 1).cast("bigint"))


def cell_indexes(lat: Column, lon: Column, length: int) -> tuple[Column, Column]:
    """Integer column and row of a point: cheaper group keys than the text."""
    bits = 5 * length
    return _index(lon, -180.0, 360.0, (bits + 1) // 2), _index(lat, -90.0, 180.0, bits // 2)


def geohash_text(x: Column, y: Column, length: int) -> Column:
    """Cell indexes to the geohash: bits alternate, longitude first, five per letter."""
    bits = 5 * length
    x_bits, y_bits = (bits + 1) // 2, bits // 2
    letters = []
    for letter in range(length):
        value = F.lit(0).cast("bigint")
        for place in range(5):
            bit = letter * 5 + place
            source, left = (x, x_bits - 1 - bit // 2) if bit % 2 == 0 else (y, y_bits - 1 - bit // 2)
            value = value * 2 + F.shiftright(source, left).bitwiseAND(F.lit(1))
        letters.append(F.substring(F.lit(ALPHABET), value.cast("int") + 1, F.lit(1)))
    return F.concat(*letters)


def heatmap(df: DataFrame, zoom: int, box: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0),
            mode: str = "GEO_BOUNDS", buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Cells of a box (left, bottom, right, top), most populated first.

    One map-side combined aggregation on two integers; the text is made per cell.
    """
    lat, lon = F.col("decimallatitude"), F.col("decimallongitude")
    length = length_of(zoom)
    x, y = cell_indexes(lat, lon, length)
    if mode == "GEO_BOUNDS":
        shape = [F.max(lat).alias("top"), F.min(lon).alias("left"), F.min(lat).alias("bottom"), F.max(lon).alias("right")]
    elif mode == "GEO_CENTROID":
        shape = [F.avg(lat).alias("latitude"), F.avg(lon).alias("longitude")]
    else:
        raise ValueError(f"unknown heatmap mode {mode}")
    cells = (
        df.filter(F.col("hascoordinate") & bounding_box(lat, lon, *box))
        .groupBy(x.alias("x"), y.alias("y"))
        .agg(F.count("*").alias("count"), *shape)
    )
    named = cells.withColumn("cell", geohash_text(F.col("x"), F.col("y"), length)).drop("x", "y")
    return named.orderBy(F.desc("count"), "cell").limit(max(buckets, MIN_CELL_LIMIT))
