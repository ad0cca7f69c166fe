"""Grid cell codes as SQL expressions over latitude and longitude.

The grids are defined by their publishers: the EEA reference grid and the Eurostat
grid on ETRS89-LAEA, extended quarter-degree cells, a degree-minute-second grid and
the military grid on UTM.  Written as SQL text because the same text serves the
column API and the functions registered for user SQL; ``size``, ``lat`` and ``lon``
are SQL fragments (column names, literals or parameters).  Out of range gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightings.operators.hot import hashed_number

# ETRS89-LAEA (EPSG:3035), UTM and the military grid's letters.
LAEA_LAT0, LAEA_LON0 = 52.0, 10.0
LAEA_FALSE_EASTING, LAEA_FALSE_NORTHING = 4321000.0, 3210000.0
SEMI_MAJOR = 6378137.0
GRS80_FLATTENING = 1 / 298.257222101
WGS84_FLATTENING = 1 / 298.257223563
UTM_SCALE, UTM_FALSE_EASTING, UTM_FALSE_NORTHING = 0.9996, 500000.0, 10000000.0
MGRS_BANDS = "CDEFGHJKLMNPQRSTUVWX"
MGRS_COLUMNS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
MGRS_ROWS = "ABCDEFGHJKLMNPQRSTUV"


def _d(number: float) -> str:
    return f"({number!r}D)"


def _valid(lat: str, lon: str) -> str:
    return f"{lat} BETWEEN -90 AND 90 AND {lon} BETWEEN -180 AND 180"


def laea(lat: str, lon: str) -> tuple[str, str]:
    """Easting and northing in EPSG:3035."""
    e2 = GRS80_FLATTENING * (2 - GRS80_FLATTENING)
    e = math.sqrt(e2)

    def q_number(sine: float) -> float:
        return (1 - e2) * (sine / (1 - e2 * sine * sine) - math.log((1 - e * sine) / (1 + e * sine)) / (2 * e))

    qp = q_number(1.0)
    phi0 = math.radians(LAEA_LAT0)
    beta0 = math.asin(q_number(math.sin(phi0)) / qp)
    radius = SEMI_MAJOR * math.sqrt(qp / 2)
    d = SEMI_MAJOR * (math.cos(phi0) / math.sqrt(1 - e2 * math.sin(phi0) ** 2)) / (radius * math.cos(beta0))
    sine = f"sin(radians({lat}))"
    q = (f"(({sine}) / (1 - {_d(e2)} * {sine} * {sine})"
         f" - ln((1 - {_d(e)} * {sine}) / (1 + {_d(e)} * {sine})) / {_d(2 * e)}) * {_d(1 - e2)}")
    beta = f"asin(greatest(-1D, least(1D, ({q}) / {_d(qp)})))"
    turn = f"radians(({lon}) - {_d(LAEA_LON0)})"
    spread = (f"1D + sin({beta}) * {_d(math.sin(beta0))} + cos({beta}) * {_d(math.cos(beta0))} * cos({turn})")
    b = f"sqrt(try_divide(2D, {spread})) * {_d(radius)}"
    east = f"({b} * {_d(d)} * cos({beta}) * sin({turn}) + {_d(LAEA_FALSE_EASTING)})"
    north = (f"({b} / {_d(d)} * (sin({beta}) * {_d(math.cos(beta0))} - cos({beta}) * {_d(math.sin(beta0))} * cos({turn}))"
             f" + {_d(LAEA_FALSE_NORTHING)})")
    return east, north


def _corner(metres: str, size: str) -> str:
    return f"(CAST(floor({metres} / ({size})) AS BIGINT) * CAST({size} AS BIGINT))"


def eea(size: str, lat: str, lon: str) -> str:
    """``1kmE4321N3210``: the corner in units of the size's power of ten."""
    east, north = laea(lat, lon)
    text = f"CAST({size} AS STRING)"
    unit = f"CAST(pow(10, length({text}) - length(trim(TRAILING '0' FROM {text}))) AS BIGINT)"
    label = f"CASE WHEN ({size}) % 1000 = 0 THEN concat(CAST(CAST(({size}) / 1000 AS BIGINT) AS STRING), 'km') ELSE concat({text}, 'm') END"

    def part(metres: str) -> str:
        return f"CAST(CAST(floor({_corner(metres, size)} / {unit}) AS BIGINT) AS STRING)"

    return f"CASE WHEN {_valid(lat, lon)} THEN concat({label}, 'E', {part(east)}, 'N', {part(north)}) END"


def eurostat(size: str, lat: str, lon: str) -> str:
    """``CRS3035RES1000mN3210000E4321000``."""
    east, north = laea(lat, lon)
    return (f"CASE WHEN {_valid(lat, lon)} THEN concat('CRS3035RES', CAST({size} AS STRING), 'mN',"
            f" CAST({_corner(north, size)} AS STRING), 'E', CAST({_corner(east, size)} AS STRING)) END")


def _degree_name(c: str, positive: str, negative: str, width: int) -> str:
    low = f"CAST(floor({c}) AS BIGINT)"
    return (f"CASE WHEN {c} >= 0 THEN concat('{positive}', lpad(CAST({low} AS STRING), {width}, '0'))"
            f" ELSE concat('{negative}', lpad(CAST(-{low} - 1 AS STRING), {width}, '0')) END")


def quarter_degree(level: str, lat: str, lon: str) -> str:
    """``E018S33AC``: degree square, then one quadrant letter per level (A north-west … D south-east)."""
    def half(c: str) -> str:
        return f"pmod(CAST(floor(({c}) * pow(2, step)) AS BIGINT), 2)"

    letters = (f"array_join(transform(sequence(1, CAST({level} AS INT)), step ->"
               f" substring('CDAB', CAST({half(lat)} * 2 + {half(lon)} AS INT) + 1, 1)), '')")
    return (f"CASE WHEN {_valid(lat, lon)} THEN concat({_degree_name(lon, 'E', 'W', 3)}, {_degree_name(lat, 'N', 'S', 2)},"
            f" CASE WHEN {level} > 0 THEN {letters} ELSE '' END) END")


def _dms(c: str, seconds: str, positive: str, negative: str, width: int) -> str:
    corner = _corner(f"({c}) * 3600", seconds)

    def two(x: str) -> str:
        return f"lpad(CAST({x} AS STRING), 2, '0')"

    return (f"concat(CASE WHEN {corner} >= 0 THEN '{positive}' ELSE '{negative}' END,"
            f" lpad(CAST(abs({corner}) div 3600 AS STRING), {width}, '0'), ':',"
            f" {two(f'abs({corner}) % 3600 div 60')}, ':', {two(f'abs({corner}) % 60')})")


def degree_minute_second(seconds: str, lat: str, lon: str) -> str:
    """``N57:55:00E010:05:00``: south-west corner of a cell the given seconds wide."""
    return (f"CASE WHEN {_valid(lat, lon)} THEN concat({_dms(lat, seconds, 'N', 'S', 2)}, {_dms(lon, seconds, 'E', 'W', 3)}) END")


def utm_zone(lat: str, lon: str) -> str:
    """Six-degree zone with the published exceptions for Norway and Svalbard."""
    return (
        f"CASE WHEN {lat} >= 56 AND {lat} < 64 AND {lon} >= 3 AND {lon} < 12 THEN 32"
        f" WHEN {lat} >= 72 AND {lon} >= 0 AND {lon} < 9 THEN 31"
        f" WHEN {lat} >= 72 AND {lon} >= 9 AND {lon} < 21 THEN 33"
        f" WHEN {lat} >= 72 AND {lon} >= 21 AND {lon} < 33 THEN 35"
        f" WHEN {lat} >= 72 AND {lon} >= 33 AND {lon} < 42 THEN 37"
        f" ELSE pmod(CAST(floor(({lon} + 180) / 6) AS INT), 60) + 1 END"
    )


def utm(lat: str, lon: str, zone: str) -> tuple[str, str]:
    """Easting and northing by the series of the transverse Mercator in the third flattening."""
    f = WGS84_FLATTENING
    n = f / (2 - f)
    e = math.sqrt(f * (2 - f))
    scale = UTM_SCALE * SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    )
    sine = f"sin(radians({lat}))"
    turn = f"radians({lon} - ({zone} * 6 - 183))"
    t = f"sinh(atanh({sine}) - atanh({sine} * {_d(e)}) * {_d(e)})"
    xi = f"atan2({t}, cos({turn}))"
    eta = f"atanh(sin({turn}) / sqrt(1 + {t} * {t}))"
    east = " + ".join([eta] + [f"cos({xi} * {2 * j}) * sinh({eta} * {2 * j}) * {_d(a)}" for j, a in enumerate(alpha, 1)])
    north = " + ".join([xi] + [f"sin({xi} * {2 * j}) * cosh({eta} * {2 * j}) * {_d(a)}" for j, a in enumerate(alpha, 1)])
    return (f"(({east}) * {_d(scale)} + {_d(UTM_FALSE_EASTING)})",
            f"(({north}) * {_d(scale)} + CASE WHEN {lat} < 0 THEN {_d(UTM_FALSE_NORTHING)} ELSE 0D END)")


def military(size: str, lat: str, lon: str) -> str:
    """``31UDQ4811``: zone, band, 100 km square, then digits for the cell size in metres.

    Zone, easting and northing are bound once, as lambda variables over a one-element
    array; the series would otherwise be repeated in every part of the code.
    """
    east, north = utm("p.lat", "p.lon", "p.zone")
    digits = f"(6 - length(CAST({size} AS STRING)))"

    def figures(c: str) -> str:
        return f"CASE WHEN {digits} > 0 THEN lpad(CAST(pmod(CAST({c} AS BIGINT), 100000) div ({size}) AS STRING), {digits}, '0') ELSE '' END"

    code = (
        "concat(lpad(CAST(u.zone AS STRING), 2, '0'),"
        f" substring('{MGRS_BANDS}', least(19, CAST(floor((u.lat + 80) / 8) AS INT)) + 1, 1),"
        f" substring('{MGRS_COLUMNS}', pmod(u.zone - 1, 3) * 8 + CAST(u.east div 100000 AS INT), 1),"
        f" substring('{MGRS_ROWS}', CAST(pmod(u.north div 100000 + CASE WHEN u.zone % 2 = 0 THEN 5 ELSE 0 END, 20) AS INT) + 1, 1),"
        f" {figures('u.east')}, {figures('u.north')})"
    )
    zoned = f"array(named_struct('lat', CAST({lat} AS DOUBLE), 'lon', CAST({lon} AS DOUBLE), 'zone', {utm_zone(lat, lon)}))"
    projected = (f"transform({zoned}, p -> named_struct('lat', p.lat, 'zone', p.zone,"
                 f" 'east', CAST(floor({east}) AS BIGINT), 'north', CAST(floor({north}) AS BIGINT)))")
    return (f"CASE WHEN {_valid(lat, lon)} AND {lat} >= -80 AND {lat} < 84 THEN"
            f" transform({projected}, u -> {code})[0] END")


GRIDS = {
    "eea": eea,
    "eurostat": eurostat,
    "eqdgc": quarter_degree,
    "dmsg": degree_minute_second,
    "mgrs": military,
}


def displaced(record_id: Column, lat: Column, lon: Column, uncertainty: Column) -> tuple[Column, Column]:
    """A point inside the uncertainty circle, drawn from the record id so that retries agree."""

    def draw(salt: str) -> Column:
        return hashed_number(record_id, salt) / float(1 << 32)

    radius = F.coalesce(uncertainty, F.lit(0.0)) * F.sqrt(draw("radius"))
    angle = draw("angle") * (2 * math.pi)
    metres_per_degree = math.pi * 6371008.7714 / 180
    north = lat + radius * F.cos(angle) / metres_per_degree
    east = lon + radius * F.sin(angle) / (F.greatest(F.cos(F.radians(lat)), F.lit(0.01)) * metres_per_degree)
    moved_lat = F.greatest(F.lit(-90.0), F.least(F.lit(90.0), north))
    return moved_lat, F.pmod(east + 180, F.lit(360.0)) - 180


def grid_cell(scheme: str, size: int, lat: str = "decimallatitude", lon: str = "decimallongitude") -> Column:
    """Cell code of a scheme for two coordinate columns."""
    if scheme not in GRIDS:
        raise ValueError(f"unknown grid {scheme}")
    return F.expr(GRIDS[scheme](str(size), lat, lon))
