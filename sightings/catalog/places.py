"""Spatial filters, heatmaps and grid cells."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sightings.catalog.registry import query
from sightings.operators import geo, grids
from sightings.operators.heatmap import ALPHABET, heatmap
from sightings.operators.params import search_predicate
from sightings.operators.predicates import Filters
from sightings.operators.shapes import parse_wkt
from sightings.sources.driver import cte, sighting



def _point():
    return F.col("decimallatitude"), F.col("decimallongitude")


COORDINATES = ("recordid", "decimallatitude", "decimallongitude")

# A ring with a hole, and a ring whose edge spans the dateline.
HOLED = ("POLYGON ((-60 -40, 70 -35, 90 20, 20 60, -50 45, -60 -40),"
         " (-20 -10, 30 -10, 30 25, -20 25, -20 -10))")
PACIFIC = "POLYGON ((150 -50, -140 -45, -150 40, 160 30, 150 -50))"
CLOCKWISE = "POLYGON ((-120 -30, -120 30, 100 30, 100 -30, -120 -30))"
MULTI = "MULTIPOLYGON (((0 0, 40 0, 40 40, 0 40, 0 0)), ((-100 -60, -40 -60, -70 -10, -100 -60)))"


def polygon_sql(rings, x: str = "decimallongitude", y: str = "decimallatitude") -> str:
    """Even-odd rule and edge test of a polygon as plain SQL."""
    edges = [(*a, *b) for ring in rings for a, b in zip(ring, ring[1:])]
    crossed = " + ".join(
        f"CASE WHEN ({y0} > {y}) <> ({y1} > {y}) AND {x} < ({x1 - x0}) * ({y} - ({y0})) / ({y1 - y0}) + ({x0}) THEN 1 ELSE 0 END"
        for x0, y0, x1, y1 in edges if y0 != y1)
    touched = " OR ".join(
        f"(({x1 - x0}) * ({y} - ({y0})) = ({y1 - y0}) * ({x} - ({x0})) AND {x} BETWEEN {min(x0, x1)} AND {max(x0, x1)} AND {y} BETWEEN {min(y0, y1)} AND {max(y0, y1)})"
        for x0, y0, x1, y1 in edges)
    return f"((({crossed}) % 2 = 1) OR {touched})"


def _shape_sql(wkt: str) -> str:
    tests = []
    for rings in parse_wkt(wkt).polygons:
        tests += [polygon_sql(rings, f"(decimallongitude + {shift}.0)") for shift in (0, 360)]
    return "(" + " OR ".join(tests) + ")"


def _select(where: str, *more: str) -> str:
    return f"WITH {cte(*COORDINATES, *more)} SELECT recordid FROM occ WHERE {where}"


@query("GEO1", _select(f"decimallatitude IS NOT NULL AND ({_shape_sql(HOLED)} OR {_shape_sql(PACIFIC)}"
                       " OR (decimallatitude BETWEEN -30 AND 30 AND (decimallongitude >= 100 OR decimallongitude <= -120)))"))
def within_polygons(spark, sf_dir):
    """A holed polygon, one over the dateline, and a clockwise rectangle."""
    df = sighting(spark, sf_dir, *COORDINATES)
    tests = [geo.within(wkt, *_point()) for wkt in (HOLED, PACIFIC, CLOCKWISE)]
    return df.filter(geo.any_of(tests)).select("recordid")


def _haversine_sql(lat: float, lon: float) -> str:
    return (f"2 * 6371008.7714 * asin(sqrt(least(1.0, pow(sin(radians(decimallatitude - ({lat})) / 2), 2)"
            f" + cos(radians({lat})) * cos(radians(decimallatitude)) * pow(sin(radians(decimallongitude - ({lon})) / 2), 2))))")


@query("GEO2", _select(f"{_haversine_sql(56.0, 12.0)} <= 2500000"))
def distance_filter(spark, sf_dir):
    df = sighting(spark, sf_dir, *COORDINATES)
    return df.filter(geo.geo_distance(56.0, 12.0, "2500km", *_point())).select("recordid")


@query("GEO3", _select(f"decimallatitude IS NOT NULL AND ({_shape_sql(MULTI)} OR"
                       " (decimallatitude = decimallongitude AND decimallongitude BETWEEN -80 AND -10))"))
def search_shapes(spark, sf_dir):
    predicate = {"type": "or", "predicates": [
        {"type": "within", "geometry": MULTI},
        {"type": "within", "geometry": "LINESTRING (-80 -80, -40 -40, -40 -40, -10 -10)"},
        {"type": "within", "geometry": "POINT (300 10)"}]}
    return Filters().apply(sighting(spark, sf_dir, *COORDINATES), predicate).select("recordid")


@query("GEO4", _select("decimallatitude BETWEEN 10 AND 50 AND (decimallongitude >= 170 OR decimallongitude <= -100)"))
def box_filter(spark, sf_dir):
    df = sighting(spark, sf_dir, *COORDINATES)
    return df.filter(geo.bounding_box(*_point(), 170.0, 10.0, -100.0, 50.0)).select("recordid")


@query("GEO5", _select(f"decimallatitude IS NOT NULL AND year = 1999 AND ({_shape_sql(MULTI)} OR {_shape_sql(HOLED)}) "
                       f"AND ({_haversine_sql(20, 20)} <= 3000000 OR {_haversine_sql(-30, -60)} <= 1000000)", "year"))
def several_geometries(spark, sf_dir):
    predicate = search_predicate({
        "GEOMETRY": [MULTI, HOLED], "GEO_DISTANCE": ["20,20,3000km", "-30,-60,1000km"], "YEAR": ["1999"]})
    return Filters().apply(sighting(spark, sf_dir, *COORDINATES, "year"), predicate).select("recordid")


HEAT = ("decimallatitude", "decimallongitude", "hascoordinate")


def _geohash_sql(length: int) -> str:
    bits = 5 * length
    xb, yb = (bits + 1) // 2, bits // 2
    x = f"least(CAST(floor((decimallongitude + 180) / 360.0 * {1 << xb}) AS BIGINT), {(1 << xb) - 1})"
    y = f"least(CAST(floor((decimallatitude + 90) / 180.0 * {1 << yb}) AS BIGINT), {(1 << yb) - 1})"
    letters = []
    for letter in range(length):
        bits_of = []
        for place in range(5):
            bit = letter * 5 + place
            source, left = (x, xb - 1 - bit // 2) if bit % 2 == 0 else (y, yb - 1 - bit // 2)
            bits_of.append(f"(({source} >> {left}) & 1) * {1 << (4 - place)}")
        letters.append(f"substr('{ALPHABET}', CAST({' + '.join(bits_of)} AS INT) + 1, 1)")
    return " || ".join(letters)


def _heat_sql(length: int, box: str, columns: str, limit: int) -> str:
    return (f"WITH {cte(*HEAT)} SELECT {_geohash_sql(length)} AS cell, count(*) AS count{columns} FROM occ"
            f" WHERE hascoordinate AND {box} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit}")


_WORLD = "decimallatitude BETWEEN -90 AND 90 AND decimallongitude BETWEEN -180 AND 180"


@query("GEO6", _heat_sql(4, "decimallatitude BETWEEN -40 AND 70 AND decimallongitude BETWEEN -100 AND 60", "", 50000))
def geohash_counts(spark, sf_dir):
    df = sighting(spark, sf_dir, *HEAT)
    return heatmap(df, zoom=4, box=(-100.0, -40.0, 60.0, 70.0)).select("cell", "count")


@query("GEO7", _heat_sql(2, _WORLD, ", max(decimallatitude) AS top, min(decimallongitude) AS \"left\","
                         " min(decimallatitude) AS bottom, max(decimallongitude) AS \"right\"", 50000))
def geohash_bounds(spark, sf_dir):
    return heatmap(sighting(spark, sf_dir, *HEAT), zoom=0)


@query("GEO8", _heat_sql(3, _WORLD, ", round(avg(decimallatitude), 6) AS latitude, round(avg(decimallongitude), 6) AS longitude", 50000))
def geohash_centroids(spark, sf_dir):
    cells = heatmap(sighting(spark, sf_dir, *HEAT), zoom=2, mode="GEO_CENTROID")
    return cells.select("cell", "count", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query("GEO9", _heat_sql(10, _WORLD, "", 50000))
def geohash_cell_limit(spark, sf_dir):
    return heatmap(sighting(spark, sf_dir, *HEAT), zoom=18).select("cell", "count")


def _laea_sql() -> tuple[str, str]:
    """EPSG:3035 easting and northing, constants worked out here."""
    f = 1 / 298.257222101
    e2 = 2 * f - f * f
    e = math.sqrt(e2)

    def q(s):
        return (1 - e2) * (s / (1 - e2 * s * s) - (1 / (2 * e)) * math.log((1 - e * s) / (1 + e * s)))

    qp, q0 = q(1.0), q(math.sin(math.radians(52)))
    b0 = math.asin(q0 / qp)
    rq = 6378137.0 * math.sqrt(qp / 2)
    d = 6378137.0 * math.cos(math.radians(52)) / math.sqrt(1 - e2 * math.sin(math.radians(52)) ** 2) / (rq * math.cos(b0))
    s = "sin(radians(decimallatitude))"
    beta = f"asin(greatest(-1.0, least(1.0, {1 - e2!r} * ({s} / (1 - {e2!r} * {s} * {s}) - ln((1 - {e!r} * {s}) / (1 + {e!r} * {s})) / {2 * e!r}) / {qp!r})))"
    turn = "radians(decimallongitude - 10)"
    b = f"{rq!r} * sqrt(2.0 / (1 + {math.sin(b0)!r} * sin({beta}) + {math.cos(b0)!r} * cos({beta}) * cos({turn})))"
    east = f"4321000 + {b} * {d!r} * cos({beta}) * sin({turn})"
    north = f"3210000 + ({b}) / {d!r} * ({math.cos(b0)!r} * sin({beta}) - {math.sin(b0)!r} * cos({beta}) * cos({turn}))"
    return east, north


_EAST, _NORTH = _laea_sql()


def _grid_sql(code: str, *more: str) -> str:
    return f"WITH {cte('decimallatitude', 'decimallongitude', *more)} SELECT {code} AS cell, count(*) AS n FROM occ GROUP BY 1"


def _grid_counts(spark, sf_dir, scheme: str, size: int):
    df = sighting(spark, sf_dir, "decimallatitude", "decimallongitude")
    return df.groupBy(grids.grid_cell(scheme, size).alias("cell")).agg(F.count("*").alias("n"))


@query("GEO10", _grid_sql(f"CASE WHEN decimallatitude IS NOT NULL THEN '10kmE' || CAST(CAST(floor(({_EAST}) / 10000) AS BIGINT) AS VARCHAR)"
                          f" || 'N' || CAST(CAST(floor(({_NORTH}) / 10000) AS BIGINT) AS VARCHAR) END"))
def eea_cells(spark, sf_dir):
    return _grid_counts(spark, sf_dir, "eea", 10000)


@query("GEO11", _grid_sql(f"CASE WHEN decimallatitude IS NOT NULL THEN 'CRS3035RES100000mN' || CAST(CAST(floor(({_NORTH}) / 100000) AS BIGINT) * 100000 AS VARCHAR)"
                          f" || 'E' || CAST(CAST(floor(({_EAST}) / 100000) AS BIGINT) * 100000 AS VARCHAR) END"))
def eurostat_cells(spark, sf_dir):
    return _grid_counts(spark, sf_dir, "eurostat", 100000)


_DEGREE = (
    "(CASE WHEN decimallongitude >= 0 THEN 'E' || lpad(CAST(CAST(floor(decimallongitude) AS INT) AS VARCHAR), 3, '0')"
    " ELSE 'W' || lpad(CAST(CAST(-floor(decimallongitude) - 1 AS INT) AS VARCHAR), 3, '0') END)"
    " || (CASE WHEN decimallatitude >= 0 THEN 'N' || lpad(CAST(CAST(floor(decimallatitude) AS INT) AS VARCHAR), 2, '0')"
    " ELSE 'S' || lpad(CAST(CAST(-floor(decimallatitude) - 1 AS INT) AS VARCHAR), 2, '0') END)")


def _quadrant_sql(step: int) -> str:
    x = f"((CAST(floor(decimallongitude * {2**step}) AS BIGINT) % 2 + 2) % 2)"
    y = f"((CAST(floor(decimallatitude * {2**step}) AS BIGINT) % 2 + 2) % 2)"
    return f" || substr('CDAB', CAST({y} * 2 + {x} AS INT) + 1, 1)"


@query("GEO12", _grid_sql(f"{_DEGREE}{_quadrant_sql(1)}{_quadrant_sql(2)}"))
def quarter_degree_cells(spark, sf_dir):
    return _grid_counts(spark, sf_dir, "eqdgc", 2)


def _dms_sql(c: str, seconds: int, positive: str, negative: str, width: int) -> str:
    corner = f"(CAST(floor({c} * 3600 / {seconds}) AS BIGINT) * {seconds})"
    return (f"(CASE WHEN {corner} >= 0 THEN '{positive}' ELSE '{negative}' END)"
            f" || lpad(CAST(abs({corner}) // 3600 AS VARCHAR), {width}, '0')"
            f" || ':' || lpad(CAST((abs({corner}) % 3600) // 60 AS VARCHAR), 2, '0')"
            f" || ':' || lpad(CAST(abs({corner}) % 60 AS VARCHAR), 2, '0')")


@query("GEO13", _grid_sql(f"{_dms_sql('decimallatitude', 7200, 'N', 'S', 2)} || {_dms_sql('decimallongitude', 7200, 'E', 'W', 3)}"))
def degree_minute_second_cells(spark, sf_dir):
    return _grid_counts(spark, sf_dir, "dmsg", 7200)


def military_cte(size: int) -> str:
    """Zone, easting and northing on UTM as CTEs over ``occ``; ``code`` holds the cell."""
    f = 1 / 298.257223563
    n, e = f / (2 - f), math.sqrt(f * (2 - f))
    k = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    a = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    east = " + ".join(f"{c!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(a, 1))
    north = " + ".join(f"{c!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(a, 1))
    digits = 5 - round(math.log10(size))
    figures = "" if digits == 0 else "".join(f" || lpad(CAST((CAST(floor({c}) AS BIGINT) % 100000) // {size} AS VARCHAR), {digits}, '0')" for c in ("east", "north"))
    return (
        "z AS (SELECT *, CASE WHEN decimallatitude >= 56 AND decimallatitude < 64 AND decimallongitude >= 3 AND decimallongitude < 12 THEN 32"
        " WHEN decimallatitude >= 72 AND decimallongitude >= 0 AND decimallongitude < 9 THEN 31 WHEN decimallatitude >= 72 AND decimallongitude >= 9 AND decimallongitude < 21 THEN 33"
        " WHEN decimallatitude >= 72 AND decimallongitude >= 21 AND decimallongitude < 33 THEN 35 WHEN decimallatitude >= 72 AND decimallongitude >= 33 AND decimallongitude < 42 THEN 37"
        " ELSE CAST(floor((decimallongitude + 180) / 6) AS INT) % 60 + 1 END AS zone FROM occ),"
        " t AS (SELECT *, radians(decimallongitude - (zone * 6 - 183)) AS turn,"
        f" sinh(atanh(sin(radians(decimallatitude))) - {e!r} * atanh({e!r} * sin(radians(decimallatitude)))) AS tau FROM z WHERE decimallatitude >= -80 AND decimallatitude < 84),"
        " x AS (SELECT *, atan2(tau, cos(turn)) AS xi, atanh(sin(turn) / sqrt(1 + tau * tau)) AS eta FROM t),"
        f" u AS (SELECT *, ({k!r} * (eta + {east})) + 500000 AS east, ({k!r} * (xi + {north})) + CASE WHEN decimallatitude < 0 THEN 10000000 ELSE 0 END AS north FROM x),"
        " code AS (SELECT *, lpad(CAST(zone AS VARCHAR), 2, '0') || substr('CDEFGHJKLMNPQRSTUVWX', least(19, CAST(floor((decimallatitude + 80) / 8) AS INT)) + 1, 1)"
        " || substr('ABCDEFGHJKLMNPQRSTUVWXYZ', ((zone - 1) % 3) * 8 + CAST(floor(east / 100000) AS INT), 1)"
        f" || substr('ABCDEFGHJKLMNPQRSTUV', (CAST(floor(north / 100000) AS INT) + CASE WHEN zone % 2 = 0 THEN 5 ELSE 0 END) % 20 + 1, 1){figures} AS cell FROM u)")


@query("GEO14", f"WITH {cte('decimallatitude', 'decimallongitude')}, {military_cte(10000)} SELECT cell, count(*) AS n FROM code GROUP BY 1"
                " UNION ALL SELECT NULL, count(*) FROM occ WHERE decimallatitude IS NULL OR decimallatitude < -80 OR decimallatitude >= 84")
def military_cells(spark, sf_dir):
    return _grid_counts(spark, sf_dir, "mgrs", 10000)


_METRES_PER_DEGREE = math.pi * 6371008.7714 / 180


def _draw_sql(salt: str) -> str:
    return f"(CAST('0x' || substr(md5(recordid || '|{salt}'), 1, 8) AS BIGINT) / 4294967296.0)"


_MOVED = (
    "SELECT * REPLACE (greatest(-90.0, least(90.0, decimallatitude + r * cos(angle) / " + f"{_METRES_PER_DEGREE!r})) AS decimallatitude,"
    f" ((decimallongitude + r * sin(angle) / (greatest(cos(radians(decimallatitude)), 0.01) * {_METRES_PER_DEGREE!r}) + 180 + 360.0) % 360.0) - 180 AS decimallongitude) FROM"
    f" (SELECT *, coalesce(coordinateuncertaintyinmeters, 1000) * sqrt({_draw_sql('radius')}) AS r, {_draw_sql('angle')} * {2 * math.pi!r} AS angle FROM occ)")


@query("GEO15", f"WITH {cte(*COORDINATES, 'coordinateuncertaintyinmeters')}, moved AS ({_MOVED}) SELECT CASE WHEN decimallatitude IS NOT NULL THEN"
                f" '10kmE' || CAST(CAST(floor(({_EAST}) / 10000) AS BIGINT) AS VARCHAR) || 'N' || CAST(CAST(floor(({_NORTH}) / 10000) AS BIGINT) AS VARCHAR) END AS cell, count(*) AS n FROM moved GROUP BY 1")
def displaced_cells(spark, sf_dir):
    df = sighting(spark, sf_dir, *COORDINATES, "coordinateuncertaintyinmeters")
    lat, lon = grids.displaced(F.col("recordid"), *_point(), F.coalesce("coordinateuncertaintyinmeters", F.lit(1000.0)))
    moved = df.select(lat.alias("decimallatitude"), lon.alias("decimallongitude"))
    return moved.groupBy(grids.grid_cell("eea", 10000).alias("cell")).agg(F.count("*").alias("n"))
