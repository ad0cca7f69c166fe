"""Standardisation jobs over the verbatim columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightings.catalog.joins import layer_sql, nation_layer
from sightings.catalog.registry import query
from sightings.plans import interpret
from sightings.sources.driver import cte, sighting, table


def _epoch(day: str) -> str:
    return f"CAST(epoch(CAST({day} AS TIMESTAMP)) AS BIGINT)"


# The seven kinds of dates of the fixture, by what the texts look like.
_DATE_SQL = f"""
WITH {cte('recordid', *interpret.RAW_DATES)},
a AS (SELECT *, CAST(v_year AS INT) AS y, CAST(v_month AS INT) AS m, CAST(v_day AS INT) AS d, make_date(CAST(v_year AS INT), 1, 1) AS jan FROM occ),
b AS (SELECT recordid, CASE
    WHEN v_eventdate LIKE '%/%' THEN CAST(split_part(v_eventdate, '/', 1) AS DATE)
    WHEN v_eventdate IS NULL THEN jan + CAST(v_startdayofyear AS INT) - 1
    WHEN regexp_matches(v_eventdate, '^[0-9-]+$') AND substr(v_eventdate, 1, 4) = v_year THEN make_date(y, m, d) END AS first,
  CASE WHEN v_eventdate LIKE '%/%' THEN CAST(split_part(v_eventdate, '/', 2) AS DATE)
    WHEN v_eventdate IS NULL THEN jan + CAST(v_enddayofyear AS INT) - 1
    WHEN regexp_matches(v_eventdate, '^[0-9-]+$') AND substr(v_eventdate, 1, 4) = v_year THEN make_date(y, m, d) END AS last FROM a)
SELECT recordid, CASE WHEN year(first) = year(last) THEN CAST(year(first) AS INT) ELSE -1 END AS year,
  CASE WHEN year(first) = year(last) AND month(first) = month(last) THEN CAST(month(first) AS INT) ELSE -1 END AS month,
  CASE WHEN first = last THEN CAST(day(first) AS INT) ELSE -1 END AS day,
  coalesce({_epoch('first')}, -1) AS epoch_from, coalesce({_epoch('last + 1')} - 1, -1) AS epoch_to FROM b"""


def _filled(df, *numbers: str):
    return df.select("recordid", *[F.coalesce(F.col(n), F.lit(-1)).alias(n) for n in numbers])


@query("INT1", _DATE_SQL)
def dates(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", *interpret.RAW_DATES)
    return _filled(interpret.standardise_dates(df), "year", "month", "day", "epoch_from", "epoch_to")


@query("INT2", f"WITH {cte('recordid', 'basisofrecord')} SELECT recordid, basisofrecord FROM occ")
def basis_of_record(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "v_basisofrecord")
    return interpret.standardise_vocabulary(df, "v_basisofrecord", "basisofrecord").select("recordid", "basisofrecord")


def _nation_names(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"), F.col("n_name").alias("country"))


@query("INT3", f"WITH {cte('recordid', 'v_country', 'v_countrycode')} SELECT recordid,"
               " CASE WHEN v_country <> 'Atlantis' THEN upper(v_country) ELSE v_countrycode END AS country,"
               " CASE WHEN v_country = 'Atlantis' THEN 'COUNTRY_INVALID' WHEN v_countrycode IS NOT NULL AND lower(v_countrycode) <> v_country THEN 'COUNTRY_MISMATCH' ELSE '' END AS issues FROM occ")
def countries(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "v_country", "v_countrycode")
    rows = interpret.standardise_country(df, ["v_country", "v_countrycode"], _nation_names(spark, sf_dir))
    return rows.select("recordid", "country", F.array_join("countryissues", ";").alias("issues"))


_CONFUSED = (("NATION_3", "NATION_4", True), ("NATION_10", "NATION_11", False))
_FORMS = ", ".join(f"({n}, {a}, {b})" for n, (a, b) in enumerate([(1, 1), (-1, 1), (1, -1), (-1, -1)]))
_COORDINATE_SQL = f"""
WITH {cte('recordid', 'decimallatitude', 'decimallongitude', 'countrycode', 'v_country')},
p AS (SELECT recordid, decimallatitude AS lat, decimallongitude AS lon, CASE WHEN v_country <> 'Atlantis' THEN countrycode END AS country FROM occ),
form(n, a, b) AS (VALUES {_FORMS}),
tried AS (SELECT recordid, country, n, a * lat AS lat, b * lon AS lon FROM p, form WHERE lat IS NOT NULL AND (n = 0 OR country IS NOT NULL)
  UNION ALL SELECT recordid, country, 4, lon, lat FROM p WHERE lat IS NOT NULL AND country IS NOT NULL AND lon BETWEEN -90 AND 90),
located AS (SELECT t.*, n_name AS found FROM tried t JOIN nation n ON {layer_sql('t.lat', 't.lon')} UNION ALL SELECT *, 'AQ' FROM tried WHERE lat < -60),
kinds AS (SELECT *, CASE WHEN country IS NULL THEN 3 WHEN found = country THEN 0
  WHEN n = 0 AND (found, country) IN (('NATION_10', 'NATION_11'), ('NATION_11', 'NATION_10')) THEN 1
  WHEN n = 0 AND (found, country) IN (('NATION_3', 'NATION_4'), ('NATION_4', 'NATION_3')) THEN 2 END AS kind FROM located),
best AS (SELECT recordid, min((n, kind, found, lat, lon)) AS b FROM kinds WHERE kind IS NOT NULL GROUP BY 1)
SELECT p.recordid, coalesce(round(CASE WHEN b IS NOT NULL THEN b[4] ELSE p.lat END, 4), -999) AS lat,
  coalesce(round(CASE WHEN b IS NOT NULL THEN b[5] ELSE p.lon END, 4), -999) AS lon,
  CASE WHEN b IS NOT NULL THEN b[3] ELSE country END AS country,
  concat_ws(';', CASE b[1] WHEN 1 THEN 'PRESUMED_NEGATED_LATITUDE' WHEN 2 THEN 'PRESUMED_NEGATED_LONGITUDE'
    WHEN 3 THEN 'PRESUMED_NEGATED_LATITUDE;PRESUMED_NEGATED_LONGITUDE' WHEN 4 THEN 'PRESUMED_SWAPPED_COORDINATE' END,
    CASE WHEN b[2] IN (2, 3) THEN 'COUNTRY_DERIVED_FROM_COORDINATES' END,
    CASE WHEN b IS NULL AND p.lat IS NOT NULL AND country IS NOT NULL THEN 'COUNTRY_COORDINATE_MISMATCH' END) AS issues
FROM p LEFT JOIN best USING (recordid)"""


def _validated(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "decimallatitude", "decimallongitude", "countrycode", "v_country").select(
        "recordid", F.col("decimallatitude").alias("lat"), F.col("decimallongitude").alias("lon"),
        F.when(F.col("v_country") != "Atlantis", F.col("countrycode")).alias("country"))
    return interpret.validate_coordinates(df, nation_layer(spark, sf_dir), _CONFUSED)


@query("INT4", _COORDINATE_SQL)
def coordinates(spark, sf_dir):
    return _validated(spark, sf_dir).select(
        "recordid", F.coalesce(F.round("finallat", 4), F.lit(-999.0)).alias("lat"), F.coalesce(F.round("finallon", 4), F.lit(-999.0)).alias("lon"),
        F.col("finalcountry").alias("country"), F.array_join("coordinateissues", ";").alias("issues"))


@query("INT5", f"WITH v AS ({_COORDINATE_SQL}), {cte('recordid', 'countrycode', 'v_country', name='o')}"
               " SELECT recordid, CASE WHEN issues LIKE '%MISMATCH%' THEN -999 ELSE lat END AS lat, CASE WHEN issues LIKE '%MISMATCH%' THEN -999 ELSE lon END AS lon,"
               " CASE WHEN issues LIKE '%MISMATCH%' OR lat = -999 THEN CASE WHEN v_country <> 'Atlantis' THEN countrycode END ELSE country END AS country FROM v JOIN o USING (recordid)")
def contradictions(spark, sf_dir):
    rows = interpret.drop_contradictions(_validated(spark, sf_dir))
    return rows.select("recordid", F.coalesce(F.round("keptlat", 4), F.lit(-999.0)).alias("lat"),
                       F.coalesce(F.round("keptlon", 4), F.lit(-999.0)).alias("lon"), F.col("keptcountry").alias("country"))


@query("INT6", f"WITH {cte('recordid', 'v_coordinateuncertaintyinmeters', 'v_coordinateprecision')}, n AS (SELECT recordid,"
               " abs(try_cast(v_coordinateuncertaintyinmeters AS DOUBLE)) AS u, try_cast(v_coordinateprecision AS DOUBLE) AS p,"
               " v_coordinateuncertaintyinmeters IS NOT NULL AS has_u, v_coordinateprecision IS NOT NULL AS has_p FROM occ),"
               " g AS (SELECT *, coalesce(u > 0 AND u < 5000000, false) AS good_u, coalesce(p BETWEEN 0 AND 45, false) AS good_p FROM n)"
               " SELECT recordid, CASE WHEN good_u THEN u ELSE -1 END AS uncertainty, CASE WHEN good_p THEN p ELSE -1 END AS precision,"
               " concat_ws(';', CASE WHEN has_p AND NOT good_p THEN 'COORDINATE_PRECISION_INVALID' END, CASE WHEN has_u AND NOT good_u THEN 'COORDINATE_UNCERTAINTY_METERS_INVALID' END) AS issues FROM g")
def uncertainty(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "v_coordinateuncertaintyinmeters", "v_coordinateprecision")
    return interpret.validate_uncertainty(df).select(
        "recordid", F.coalesce("coordinateuncertaintyinmeters", F.lit(-1.0)).alias("uncertainty"),
        F.coalesce("coordinateprecision", F.lit(-1.0)).alias("precision"), F.array_join("uncertaintyissues", ";").alias("issues"))


@query("INT7", f"WITH {cte('recordid', 'v_minimumdepthinmeters', 'v_maximumdepthinmeters')}, n AS (SELECT recordid,"
               " try_cast(replace(v_minimumdepthinmeters, ' m', '') AS DOUBLE) AS a, try_cast(v_maximumdepthinmeters AS DOUBLE) AS b FROM occ)"
               " SELECT recordid, coalesce((a + b) / 2, a, b, -1) AS depth, coalesce(abs(b - a) / 2, -1) AS depthaccuracy FROM n")
def depth(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "v_minimumdepthinmeters", "v_maximumdepthinmeters")
    rows = interpret.standardise_range(df, "v_minimumdepthinmeters", "v_maximumdepthinmeters", "depth")
    return rows.select("recordid", *[F.coalesce(F.col(c), F.lit(-1.0)).alias(c) for c in ("depth", "depthaccuracy")])


@query("INT8", f"WITH {cte('recordid', 'v_locality', 'v_scientificname')}, c AS (SELECT recordid, trim(regexp_replace(v_locality, '\\s+', ' ', 'g')) AS l,"
               " trim(regexp_replace(v_scientificname, '\\s+', ' ', 'g')) AS s FROM occ) SELECT recordid, l AS locality,"
               " CASE WHEN regexp_matches(replace(s, ' ', ''), '^[A-Z]+$') THEN upper(substr(s, 1, 1)) || lower(substr(s, 2)) ELSE s END AS name FROM c")
def place_names(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "v_locality", "v_scientificname")
    return df.select("recordid", interpret.clean_place_name(F.col("v_locality")).alias("locality"),
                     interpret.clean_place_name(F.col("v_scientificname")).alias("name"))


def _backbone(spark, sf_dir):
    """Distinct part names as species, their first words as genera."""
    parts = table(spark, sf_dir, "part")
    species = parts.groupBy("p_name").agg(F.min("p_partkey").alias("k"), F.min("p_brand").alias("family"), F.min("p_type").alias("kingdom")).select(
        F.concat(F.lit("s"), F.col("k").cast("string")).alias("usagekey"), F.col("p_name").alias("scientificname"),
        F.col("p_name").alias("canonicalname"), F.lit("SPECIES").alias("taxonrank"), "kingdom", "family")
    genus = F.substring_index("p_name", " ", 1)
    genera = parts.groupBy(genus.alias("g")).agg(F.min("p_partkey").alias("k"), F.min("p_type").alias("kingdom")).select(
        F.concat(F.lit("g"), F.col("k").cast("string")).alias("usagekey"), F.col("g").alias("scientificname"), F.col("g").alias("canonicalname"),
        F.lit("GENUS").alias("taxonrank"), "kingdom", F.lit(None).cast("string").alias("family"))
    return species.unionByName(genera)


_TAXA_SQL = f"""
WITH {cte('recordid', 'v_scientificname', 'species')},
back AS (SELECT 's' || CAST(min(p_partkey) AS VARCHAR) AS usagekey, p_name AS name, split_part(p_name, ' ', 1) AS genus, split_part(p_name, ' ', 2) AS epithet, min(p_type) AS kingdom FROM part GROUP BY p_name),
gen AS (SELECT 'g' || CAST(min(p_partkey) AS VARCHAR) AS usagekey, split_part(p_name, ' ', 1) AS genus, min(p_type) AS kingdom FROM part GROUP BY 2),
q AS (SELECT recordid, CASE CAST(split_part(recordid, '-', 1) AS BIGINT) % 23 WHEN 0 THEN substr(species, 1, length(species) - 1) WHEN 1 THEN split_part(species, ' ', 1) || ' unknowna'
  WHEN 2 THEN 'nothing like it' ELSE lower(trim(regexp_replace(v_scientificname, '\\s+', ' ', 'g'))) END AS name FROM occ),
n AS (SELECT DISTINCT name, split_part(name, ' ', 1) AS genus, split_part(name, ' ', 2) AS epithet FROM q),
f AS (SELECT n.name, 0 AS how, usagekey, kingdom FROM n JOIN back b ON b.name = n.name
  UNION ALL SELECT n.name, 1, usagekey, kingdom FROM n JOIN back b ON b.genus = n.genus AND b.epithet = n.epithet
  UNION ALL SELECT n.name, 2, usagekey, kingdom FROM n JOIN back b ON b.genus = n.genus AND levenshtein(b.epithet, n.epithet) <= 1
  UNION ALL SELECT n.name, 3, usagekey, kingdom FROM n JOIN gen g ON g.genus = n.genus),
best AS (SELECT name, min((how, usagekey, kingdom)) AS b FROM f GROUP BY 1)
SELECT recordid, b[2] AS usagekey, b[3] AS kingdom, CASE b[1] WHEN 0 THEN 'EXACT' WHEN 1 THEN 'CANONICAL' WHEN 2 THEN 'FUZZY' WHEN 3 THEN 'HIGHERRANK' ELSE 'NONE' END AS matchtype
FROM q LEFT JOIN best USING (name)"""


@query("INT9", _TAXA_SQL)
def taxa(spark, sf_dir):
    """Names as given, with an author, in capitals, misspelled, with an unknown epithet, and unknown."""
    df = sighting(spark, sf_dir, "recordid", "v_scientificname", "species")
    order = F.pmod(F.split("recordid", "-")[0].cast("bigint"), F.lit(23))
    given = interpret.compose_name(F.col("v_scientificname"), *[F.lit(None).cast("string")] * 5)
    name = (F.when(order == 0, F.expr("substr(species, 1, length(species) - 1)"))
            .when(order == 1, F.concat(F.substring_index("species", " ", 1), F.lit(" unknowna"))).when(order == 2, "nothing like it").otherwise(given))
    rows = interpret.match_taxa(df.select("recordid", name.alias("name")), "name", _backbone(spark, sf_dir))
    return rows.select("recordid", "usagekey", "kingdom", "matchtype")


@query("INT10", f"WITH {cte('recordid', 'v_geodeticdatum')} SELECT recordid, CASE WHEN v_geodeticdatum IS NULL THEN 'GEODETIC_DATUM_ASSUMED_WGS84'"
                " WHEN v_geodeticdatum = 'WGS84' THEN '' ELSE 'GEODETIC_DATUM_INVALID;GEODETIC_DATUM_ASSUMED_WGS84' END AS issues FROM occ")
def datum(spark, sf_dir):
    rows = interpret.datum_check(sighting(spark, sf_dir, "recordid", "v_geodeticdatum"))
    return rows.select("recordid", F.array_join("datumissues", ";").alias("issues"))
