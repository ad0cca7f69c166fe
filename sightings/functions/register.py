"""The same functions under their SQL names, for user queries.

All but one are SQL functions whose body is a native expression, so nothing leaves
the JVM.  ``Within`` takes WKT as an argument that may differ per row: it is a pandas
UDF that parses each distinct text once per worker and tests whole batches.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sightings.functions.dates import temporal_uncertainty_sql
from sightings.functions.text import LINE_BREAKERS
from sightings.operators import grids
from sightings.operators.geo import DISTANCE_UNITS, EARTH_RADIUS_M
from sightings.operators.shapes import Shape, parse_wkt

def _clean(c: str) -> str:
    breakers = "\\t\\n\\r\\u000B\\u000C\\u0085\\u2028\\u2029\\u0000"
    blanks = "".join(f"\\u{code:04X}" for code in range(0x21))
    return f"trim(BOTH '{blanks}' FROM translate({c}, '{breakers}', '{' ' * len(LINE_BREAKERS)}'))"


def _iso(c: str, suffix: str) -> str:
    return f"date_format(timestamp_seconds({c}), \"yyyy-MM-dd'T'HH:mm:ss{suffix}\")"


def _millis(c: str) -> str:
    return (f"CASE WHEN pmod({c}, 1000) = 0 THEN date_format(timestamp_millis({c}), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
            f" ELSE date_format(timestamp_millis({c}), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") END")


# Wildcard pattern to regular expression: * any text, ? one character, backslash escapes.
# Escaped wildcards wait as control characters while the rest is quoted.  Built from
# plain functions only, so that a literal pattern is folded and compiled once.
_REGEX = (
    r"concat('(?s)', CASE WHEN casesensitive THEN '' ELSE '(?iu)' END, '^',"
    r" replace(replace(replace(replace(replace(regexp_replace(regexp_replace("
    r"replace(replace(replace(pattern, '\\\\', '\u0001'), '\\*', '\u0002'), '\\?', '\u0003'),"
    r" '\\\\(.)', '$1'), '([\\\\^$.|+()\\[\\]{}])', '\\\\$1'), '*', '.*'), '?', '.'),"
    r" '\u0001', '\\\\'), '\u0002', '\\*'), '\u0003', '\\?'), '$')"
)

_METRES = "CASE lower(regexp_extract(distance, '([A-Za-z]*) *$', 1)) " + " ".join(
    f"WHEN '{unit}' THEN {metres!r}D" for unit, metres in DISTANCE_UNITS.items()) + " WHEN '' THEN 1D END"
_HAVERSINE = (
    f"{2 * EARTH_RADIUS_M!r}D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2)"
    " + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"
)

_GRID_ARGS = "size INT, lat DOUBLE, lon DOUBLE, uncertainty DOUBLE"

# name -> (parameters, result type, body)
SQL_FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "cleanDelimiters": ("s STRING", "STRING", _clean("s")),
    "cleanDelimitersArray": (
        "a ARRAY<STRING>", "ARRAY<STRING>",
        f"nullif(filter(transform(a, x -> {_clean('x')}), x -> x <> ''), CAST(array() AS ARRAY<STRING>))"),
    "joinArray": ("a ARRAY<STRING>, separator STRING", "STRING", "CASE WHEN size(a) > 0 THEN array_join(a, separator) END"),
    "removeNulls": ("a ARRAY<STRING>", "ARRAY<STRING>", "nullif(array_compact(a), CAST(array() AS ARRAY<STRING>))"),
    "removeNullStrings": ("a ARRAY<STRING>", "ARRAY<STRING>", "nullif(filter(a, x -> trim(x) <> ''), CAST(array() AS ARRAY<STRING>))"),
    "SecondsToISO8601": ("s BIGINT", "STRING", _iso("s", "'Z'")),
    "SecondsToLocalISO8601": ("s BIGINT", "STRING", _iso("s", "")),
    "MillisecondsToISO8601": ("ms BIGINT", "STRING", _millis("ms")),
    "StringArrayContains": (
        "a ARRAY<STRING>, wanted STRING, casesensitive BOOLEAN", "BOOLEAN",
        "coalesce(exists(a, x -> CASE WHEN casesensitive THEN x = wanted ELSE lower(x) = lower(wanted) END), false)"),
    "StringArrayLike": (
        "a ARRAY<STRING>, pattern STRING, casesensitive BOOLEAN", "BOOLEAN",
        f"coalesce(exists(a, x -> x RLIKE {_REGEX}), false)"),
    "GeoDistance": (
        "lat1 DOUBLE, lon1 DOUBLE, distance STRING, lat2 DOUBLE, lon2 DOUBLE", "BOOLEAN",
        f"coalesce({_HAVERSINE} <= CAST(regexp_extract(distance, '([0-9.]+)', 1) AS DOUBLE) * {_METRES}, false)"),
    "TemporalUncertainty": ("eventdate STRING, eventtime STRING", "BIGINT", temporal_uncertainty_sql("eventdate", "eventtime")),
    "EEARGCode": (_GRID_ARGS, "STRING", grids.eea("size", "lat", "lon")),
    "EuroStatCode": (_GRID_ARGS, "STRING", grids.eurostat("size", "lat", "lon")),
    "EQDGCode": (_GRID_ARGS, "STRING", grids.quarter_degree("size", "lat", "lon")),
    "DMSGCode": (_GRID_ARGS, "STRING", grids.degree_minute_second("size", "lat", "lon")),
    "MGRSCode": (_GRID_ARGS, "STRING", grids.military("size", "lat", "lon")),
}


@lru_cache(maxsize=256)
def _parsed(wkt: str) -> Shape:
    return parse_wkt(wkt)


def points_in_shape(shape: Shape, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Batch form of the point test: even-odd rule over numpy arrays, edges included."""
    found = np.zeros(lat.shape, dtype=bool)
    for x, y in shape.points:
        found |= (lon == x) & (lat == y)
    for line in shape.lines:
        found |= _meets(lat, lon, [line], closed=False)
    for rings in shape.polygons:
        for shift in (0.0, 360.0, -360.0):
            found |= _meets(lat, lon + shift, rings, closed=True)
    for left, right, bottom, top in shape.wrapped:
        found |= (lat >= bottom) & (lat <= top) & ((lon >= left) | (lon <= right))
    in_range = (lat >= -90) & (lat <= 90) & (lon >= -180) & (lon <= 180)
    return found & in_range


def _meets(lat: np.ndarray, lon: np.ndarray, rings: list, closed: bool) -> np.ndarray:
    odd = np.zeros(lat.shape, dtype=bool)
    touching = np.zeros(lat.shape, dtype=bool)
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
            on_line = (x1 - x0) * (lat - y0) == (y1 - y0) * (lon - x0)
            touching |= (on_line & (lon >= min(x0, x1)) & (lon <= max(x0, x1))
                         & (lat >= min(y0, y1)) & (lat <= max(y0, y1)))
            if closed and y0 != y1:
                spans = (y0 > lat) != (y1 > lat)
                odd ^= spans & (lon < (x1 - x0) * (lat - y0) / (y1 - y0) + x0)
    return odd | touching


def _within(wkt: pd.Series, lat: pd.Series, lon: pd.Series) -> pd.Series:
    out = np.zeros(len(wkt), dtype=bool)
    usable = (wkt.notna() & lat.notna() & lon.notna()).to_numpy()
    texts = wkt.to_numpy()
    for text in pd.unique(texts[usable]):
        rows = usable & (texts == text)
        out[rows] = points_in_shape(_parsed(text), lat.to_numpy(float)[rows], lon.to_numpy(float)[rows])
    return pd.Series(out)


def register_functions(spark: SparkSession) -> list[str]:
    """Make every function available to ``spark.sql``; returns the names."""
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    # Not also as "contains": Spark's string function of that name stays usable.
    spark.udf.register("Within", F.pandas_udf(_within, "boolean"))
    return [*SQL_FUNCTIONS, "Within"]
