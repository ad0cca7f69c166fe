"""Scalar functions over the record columns, and the registered SQL names."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightings.catalog.places import _EAST, _NORTH, military_cte
from sightings.catalog.registry import query
from sightings.functions import dates, text
from sightings.functions.register import register_functions
from sightings.sources.driver import DNA_CTE, cte, dna, sighting


def _rows(columns: str, select: str) -> str:
    return f"WITH {cte('recordid', *columns.split())} SELECT recordid, {select} FROM occ"


_CLEAN = "trim(regexp_replace({0}, '[\\t\\n\\r\\x0B\\x0C]', ' ', 'g'), chr(32) || chr(9))"


@query("STR1", _rows("v_scientificname v_locality", f"{_CLEAN.format('v_scientificname')} AS name, {_CLEAN.format('v_locality')} AS locality"))
def clean_text(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "v_scientificname", "v_locality")
    return df.select("recordid", text.clean_delimiters(F.col("v_scientificname")).alias("name"),
                     text.clean_delimiters(F.col("v_locality")).alias("locality"))


@query("STR2", _rows("v_scientificname v_locality",
                     f"concat_ws('|', {_CLEAN.format('v_locality')}, {_CLEAN.format('v_scientificname')}) AS cleaned,"
                     " CAST(1 AS INT) AS blank_is_null"))
def clean_text_arrays(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "v_scientificname", "v_locality")
    cleaned = text.clean_delimiters_array(F.array("v_locality", F.lit(" \t"), "v_scientificname"))
    blank = text.clean_delimiters_array(F.array(F.lit(" "), F.lit("\n")))
    return df.select("recordid", F.array_join(cleaned, "|").alias("cleaned"), blank.isNull().cast("int").alias("blank_is_null"))


@query("STR3", _rows("recordedby_1 recordedby_2", "nullif(concat_ws(';', recordedby_1, recordedby_2), '') AS people"))
def join_text(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "recordedby")
    return df.select("recordid", text.join_array(F.col("recordedby")).alias("people"))


@query("STR4", _rows("year month", "printf('%04d-%02d', year, coalesce(month, 0)) AS yearmonth"))
def year_month_text(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "year", "month")
    return df.select("recordid", text.year_month(F.col("year"), F.coalesce("month", F.lit(0))).alias("yearmonth"))


@query("STR5", _rows("recordedby_1 recordedby_2", "concat_ws(' | ', recordedby_1, recordedby_2) AS people"))
def concat_with_separator(spark, sf_dir):
    return sighting(spark, sf_dir, "recordid", "recordedby").select("recordid", F.concat_ws(" | ", "recordedby").alias("people"))


@query("STR6", f"WITH {DNA_CTE} SELECT '>' || coalesce(nucleotidesequenceid, '') || '|' || recordid || '|' || coalesce(targetgene_concept, '')"
               " || chr(10) || sequence AS fasta FROM dna WHERE sequence IS NOT NULL")
def fasta_text(spark, sf_dir):
    rows = dna(spark, sf_dir).filter("sequence IS NOT NULL")
    return rows.select(text.fasta(F.col("nucleotidesequenceid"), F.col("recordid"), F.col("targetgene.concept"), F.col("sequence")).alias("fasta"))


@query("STR7", _rows("sex_concept month locality",
                     "coalesce(sex_concept, 'NOT_SUPPLIED') AS sex, CASE WHEN month IS NULL THEN 'none' ELSE 'some' END AS has_month,"
                     " lower(locality) LIKE 'plot 1%' AS first_plots"))
def conditional_text(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "sex", "month", "locality")
    return df.select("recordid", text.supplied(F.col("sex.concept")).alias("sex"),
                     F.expr("IF(ISNULL(month), 'none', 'some')").alias("has_month"),
                     F.lower("locality").like("plot 1%").alias("first_plots"))


@query("ARR1", _rows("collectioncode recordedby_1", "nullif(concat_ws('|', collectioncode, recordedby_1), '') AS kept"))
def remove_nulls(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "collectioncode", "recordedby_1")
    kept = text.remove_nulls(F.array("collectioncode", "recordedby_1"))
    return df.select("recordid", F.array_join(kept, "|").alias("kept"))


@query("ARR2", _rows("collectioncode recordedby_1", "nullif(concat_ws('|', collectioncode, recordedby_1), '') AS kept"))
def remove_null_strings(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "collectioncode", "recordedby_1")
    kept = text.remove_null_strings(F.array(F.lit("  "), "collectioncode", F.lit(""), "recordedby_1"))
    return df.select("recordid", F.array_join(kept, "|").alias("kept"))


@query("ARR3", f"WITH {cte('recordid')} SELECT o.recordid, p_size % 2 = 0 AS has_image FROM (SELECT recordid, split_part(recordid, '-', 3) AS pk FROM occ) o"
               " JOIN part ON CAST(p_partkey AS VARCHAR) = pk")
def array_contains(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "mediatype")
    return df.select("recordid", F.array_contains("mediatype", "StillImage").alias("has_image"))


@query("MAP1", _rows("kingdom family species", "species AS species1, CAST(NULL AS VARCHAR) AS species2, family AS family2, CAST(NULL AS VARCHAR) AS none"))
def nested_map_values(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "classificationdetails")
    details = F.col("classificationdetails")
    return df.select("recordid", text.nested_value(details, "cl-1", "species").alias("species1"),
                     text.nested_value(details, "cl-2", "species").alias("species2"),
                     text.nested_value(details, "cl-2", "family").alias("family2"),
                     text.nested_value(details, "cl-9", "family").alias("none"))


@query("STC1", _rows("sex_concept sex_root typestatus_text",
                     "sex_concept AS sex, sex_root || '/' || sex_concept AS lineage, typestatus_text AS types"))
def struct_fields(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "sex", "typestatus")
    return df.select("recordid", text.concept(F.col("sex")).alias("sex"), F.array_join(text.lineage(F.col("sex")), "/").alias("lineage"),
                     text.join_array(text.concepts(F.col("typestatus"))).alias("types"))


@query("JSN1", _rows("ext_multimedia", "unnest(from_json(ext_multimedia, '[{\"type\": \"VARCHAR\", \"identifier\": \"VARCHAR\"}]'), recursive := true)")
       + " WHERE ext_multimedia IS NOT NULL")
def json_to_rows(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "ext_multimedia")
    items = df.select("recordid", F.explode(text.media_items(F.col("ext_multimedia"))).alias("item"))
    return items.select("recordid", F.col("item")["type"].alias("type"), F.col("item")["identifier"].alias("identifier"))


@query("DAT1", _rows("eventdategte", "strftime(to_timestamp(eventdategte) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS moment"))
def seconds_utc(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "eventdategte")
    return df.select("recordid", dates.seconds_to_iso8601(F.col("eventdategte")).alias("moment"))


@query("DAT2", _rows("eventdatelte", "strftime(to_timestamp(eventdatelte) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS moment"))
def seconds_local(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "eventdatelte")
    return df.select("recordid", dates.seconds_to_local_iso8601(F.col("eventdatelte")).alias("moment"))


def _millis_sql(suffix: str) -> str:
    base = "epoch_ms(CAST(modified AS BIGINT))"
    return (f"CASE WHEN modified % 1000 = 0 THEN strftime({base}, '%Y-%m-%dT%H:%M:%S{suffix}')"
            f" ELSE strftime({base}, '%Y-%m-%dT%H:%M:%S.%g{suffix}') END")


@query("DAT3", _rows("modified", f"{_millis_sql('Z')} AS moment"))
def millis_utc(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "modified")
    return df.select("recordid", dates.millis_to_iso8601(F.col("modified")).alias("moment"))


@query("DAT4", _rows("modified", f"{_millis_sql('Z')} AS utc, {_millis_sql('')} AS local"))
def millis_both(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "modified")
    return df.select("recordid", dates.millis_to_iso8601(F.col("modified")).alias("utc"),
                     dates.millis_to_local_iso8601(F.col("modified")).alias("local"))


@query("DAT5", _rows("dateidentified", "CAST(to_timestamp(dateidentified) AT TIME ZONE 'UTC' AS VARCHAR) AS moment"))
def seconds_to_timestamp(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "dateidentified")
    return df.select("recordid", F.timestamp_seconds("dateidentified").cast("string").alias("moment"))


_UNCERTAIN = (
    "CASE WHEN length(eventdate) = 10 AND eventtime = '14:30:20' THEN 1 WHEN length(eventdate) = 10 AND eventtime = '14:30' THEN 60"
    " WHEN length(eventdate) = 4 THEN date_diff('second', CAST(eventdate || '-01-01' AS TIMESTAMP), CAST(eventdate || '-01-01' AS TIMESTAMP) + INTERVAL 1 YEAR)"
    " WHEN length(eventdate) = 7 THEN date_diff('second', CAST(eventdate || '-01' AS TIMESTAMP), CAST(eventdate || '-01' AS TIMESTAMP) + INTERVAL 1 MONTH)"
    " ELSE 86400 END")


@query("DAT6", _rows("eventdate eventtime", f"{_UNCERTAIN} AS seconds"))
def temporal_uncertainty(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "eventdate", "eventtime")
    return df.select("recordid", dates.temporal_uncertainty("eventdate", "eventtime").alias("seconds"))


@query("DAT7", _rows("eventdategte", "strftime(to_timestamp(eventdategte) AT TIME ZONE 'UTC', '%Y-%m-%d') AS parsed"))
def lenient_dates(spark, sf_dir):
    """The event day written in six different forms, read back."""
    df = sighting(spark, sf_dir, "recordid", "eventdategte")
    day = F.timestamp_seconds("eventdategte")
    forms = ["yyyy-MM-dd", "yyyy/M/d", "d.M.yyyy", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss"]
    which = F.pmod(F.crc32(F.col("recordid")), F.lit(len(forms)))
    written = F.coalesce(*[F.when(which == n, F.date_format(day, form)) for n, form in enumerate(forms)])
    return df.select("recordid", F.date_format(dates.parse_lenient(written), "yyyy-MM-dd").alias("parsed"))


@query("DAT8", _rows("eventdate",
                     "CAST(epoch(CAST(rpad(eventdate, 10, substr('0000-01-01', length(eventdate) + 1)) AS TIMESTAMP)) AS BIGINT) AS first_second,"
                     " CAST(epoch(CASE length(eventdate) WHEN 4 THEN CAST(eventdate || '-01-01' AS TIMESTAMP) + INTERVAL 1 YEAR"
                     " WHEN 7 THEN CAST(eventdate || '-01' AS TIMESTAMP) + INTERVAL 1 MONTH ELSE CAST(eventdate AS TIMESTAMP) + INTERVAL 1 DAY END) AS BIGINT) - 1 AS last_second"))
def precision_bounds(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "eventdate")
    return df.select("recordid", dates.lower_bound("eventdate").alias("first_second"), dates.upper_bound("eventdate").alias("last_second"))


_UDF_COLUMNS = ("recordid", "decimallatitude", "decimallongitude", "eventdate", "eventtime", "eventdategte", "modified",
                "issue", "recordedby", "coordinateuncertaintyinmeters")


@query("UDF1", _rows("eventdategte modified issue_1 issue_2 taxonissue_1 recordedby_1 recordedby_2 eventdate eventtime decimallatitude decimallongitude",
                     "strftime(to_timestamp(eventdategte) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS utc,"
                     f" {_millis_sql('Z')} AS changed, {_UNCERTAIN} AS seconds,"
                     " coalesce(issue_1 = 'ZERO_COORDINATE', false) AS zero,"
                     " coalesce(regexp_matches(lower(recordedby_1), '^customer#.*[0-9]7$'), false) OR coalesce(regexp_matches(lower(recordedby_2), '^customer#.*[0-9]7$'), false) AS seven,"
                     " nullif(concat_ws(';', recordedby_1, recordedby_2), '') AS people,"
                     " coalesce(2 * 6371008.7714 * asin(sqrt(least(1.0, pow(sin(radians(decimallatitude - 10) / 2), 2)"
                     " + cos(radians(10)) * cos(radians(decimallatitude)) * pow(sin(radians(decimallongitude - 20) / 2), 2)))) <= 1500000, false) AS near,"
                     " coalesce(decimallatitude BETWEEN -20 AND 35 AND decimallongitude BETWEEN 5 AND 60, false) AS inside"))
def registered_functions(spark, sf_dir):
    """User SQL over a view, calling the functions by their registered names."""
    register_functions(spark)
    sighting(spark, sf_dir, *_UDF_COLUMNS).createOrReplaceTempView("sightings_udf1")
    return spark.sql("""
        SELECT recordid, SecondsToISO8601(eventdategte) AS utc, MillisecondsToISO8601(modified) AS changed,
          TemporalUncertainty(eventdate, eventtime) AS seconds, StringArrayContains(issue, 'ZERO_COORDINATE', true) AS zero,
          StringArrayLike(recordedby, 'CUSTOMER#*?7', false) AS seven, joinArray(recordedby, ';') AS people,
          GeoDistance(10.0D, 20.0D, '1500km', decimallatitude, decimallongitude) AS near,
          Within('POLYGON ((5 -20, 60 -20, 60 35, 5 35, 5 -20))', decimallatitude, decimallongitude) AS inside
        FROM sightings_udf1""")


@query("UDF2", f"WITH {cte('decimallatitude', 'decimallongitude')}, {military_cte(100000)}, pts AS (SELECT o.*, code.cell AS mgrs FROM occ o LEFT JOIN"
               " (SELECT DISTINCT decimallatitude, decimallongitude, cell FROM code) code USING (decimallatitude, decimallongitude))"
               f" SELECT CASE WHEN decimallatitude IS NOT NULL THEN '100kmE' || CAST(CAST(floor(({_EAST}) / 100000) AS BIGINT) AS VARCHAR) || 'N' ||"
               f" CAST(CAST(floor(({_NORTH}) / 100000) AS BIGINT) AS VARCHAR) END AS eea, mgrs, count(*) AS n FROM pts GROUP BY ALL")
def typed_parameters(spark, sf_dir):
    """Grid functions by name; arguments are cast to the declared parameter types."""
    register_functions(spark)
    sighting(spark, sf_dir, *_UDF_COLUMNS).createOrReplaceTempView("sightings_udf2")
    return spark.sql("""
        SELECT EEARGCode(100000, decimallatitude, decimallongitude, coalesce(coordinateuncertaintyinmeters, 1000)) AS eea,
          MGRSCode(100000, decimallatitude, decimallongitude, 1000) AS mgrs, count(*) AS n
        FROM sightings_udf2 GROUP BY ALL""")


@query("UDF3", _rows("v_locality eventdategte", f"{_CLEAN.format('v_locality')} AS locality,"
                     " strftime(to_timestamp(eventdategte) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS local"))
def registered_text_functions(spark, sf_dir):
    register_functions(spark)
    sighting(spark, sf_dir, "recordid", "v_locality", "eventdategte").createOrReplaceTempView("sightings_udf3")
    return spark.sql("SELECT recordid, cleanDelimiters(v_locality) AS locality, SecondsToLocalISO8601(eventdategte) AS local FROM sightings_udf3")
