"""Table builds, sinks and export layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightings.catalog.registry import query
from sightings.plans import layouts, terms
from sightings.session import scratch_path
from sightings.sources import sinks, tables
from sightings.sources.driver import DNA_CTE, EVENT_CTE, HUMBOLDT_CTE, RECORD, cte, dna, event, humboldt, sighting, table

_CLEAN = "trim(regexp_replace({0}, '[\\t\\n\\r\\x0B\\x0C]', ' ', 'g'), chr(32) || chr(9))"
_UTC = "strftime(to_timestamp({0}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S')"
_MILLIS = ("CASE WHEN modified % 1000 = 0 THEN strftime(epoch_ms(CAST(modified AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ')"
           " ELSE strftime(epoch_ms(CAST(modified AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%gZ') END")


def _rows(columns: str, select: str) -> str:
    return f"WITH {cte('recordid', *columns.split())} SELECT recordid, {select} FROM occ"


# ---- sources and sinks ---------------------------------------------------------------

@query("SRC1", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL")
def fixed_schema_scan(spark, sf_dir):
    """Scan with a declared schema; only the three used columns are read."""
    schema = "l_orderkey bigint, l_quantity double, l_returnflag string, l_linestatus string"
    rows = tables.read_records(spark, f"{sf_dir}/lineitem.parquet", schema)
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SRC2", _rows("v_scientificname v_locality recordedby_1 recordedby_2 individualcount",
                     f"{_CLEAN.format('v_scientificname')} AS name, {_CLEAN.format('v_locality')} AS locality, individualcount,"
                     " nullif(concat_ws(';', recordedby_1, recordedby_2), '') AS people"))
def typed_base_table(spark, sf_dir):
    raw = sighting(spark, sf_dir, "recordid", "v_scientificname", "v_locality", "individualcount", "recordedby")
    path = scratch_path(spark, "records")
    tables.write_table(tables.build_record_table(raw), path, fmt="orc", codec="zlib")
    built = spark.read.schema(raw.schema).orc(path)
    return built.select("recordid", F.col("v_scientificname").alias("name"), F.col("v_locality").alias("locality"),
                        "individualcount", F.array_join("recordedby", ";").alias("people"))


@query("SRC3", "SELECT CAST(p_partkey AS VARCHAR) AS recordid, p_name AS name, CAST(p_size AS VARCHAR) AS size, p_type || ' x' AS kind FROM part")
def extension_table(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("recordid"), F.concat(F.lit("\t"), "p_name", F.lit("\n")).alias("name"),
        F.col("p_size").alias("size"), F.concat("p_type", F.lit("\rx ")).alias("kind"))
    return tables.build_extension_table(raw)


_MEDIA_SQL = (
    f"WITH {cte('recordid', 'ext_multimedia')} SELECT recordid, m.type AS type, m.format AS format, m.identifier AS identifier,"
    " m.title AS title, m.license AS license, m.created AS created, m.creator AS creator FROM"
    " (SELECT recordid, unnest(from_json(ext_multimedia, '[{\"type\":\"VARCHAR\",\"format\":\"VARCHAR\",\"identifier\":\"VARCHAR\","
    "\"title\":\"VARCHAR\",\"license\":\"VARCHAR\",\"created\":\"VARCHAR\",\"creator\":\"VARCHAR\"}]')) AS m FROM occ WHERE ext_multimedia IS NOT NULL)")


@query("SRC4", _MEDIA_SQL)
def multimedia_table(spark, sf_dir):
    media = tables.build_multimedia_table(sighting(spark, sf_dir, "recordid", "ext_multimedia"))
    return media.select("recordid", "type", "format", "identifier", "title", "license", "created", "creator")


@query("SRC5", "SELECT 'current' AS version, count(*) AS n FROM part WHERE p_size >= 25 UNION ALL SELECT 'old', count(*) FROM part")
def swap_versions(spark, sf_dir):
    """Publish a table, publish a rebuilt one, read both names."""
    from sightings.session import shared_folder

    parts, folder = table(spark, sf_dir, "part"), shared_folder(spark)
    name = "sightings_swap"
    for old in (name, f"old_{name}"):
        spark.sql(f"DROP VIEW IF EXISTS {old}")
    tables.publish(parts, name, folder)
    tables.publish(parts.filter("p_size >= 25"), name, folder)
    current, old = spark.table(name), spark.table(f"old_{name}")
    return current.agg(F.count("*").alias("n")).select(F.lit("current").alias("version"), "n").unionByName(
        old.agg(F.count("*").alias("n")).select(F.lit("old").alias("version"), "n"))


@query("SNK1", f"WITH {cte('recordid', 'datasetkey', 'v_locality', 'collectioncode', 'year')} SELECT recordid || chr(9) || datasetkey || chr(9) ||"
               f" coalesce({_CLEAN.format('v_locality')}, '') || chr(9) || coalesce(collectioncode, '') || chr(9) || CAST(year AS VARCHAR) AS line FROM occ")
def tsv_lines(spark, sf_dir):
    raw = sighting(spark, sf_dir, "recordid", "datasetkey", "v_locality", "collectioncode", "year")
    path = scratch_path(spark, "tsv")
    sinks.write_tsv(tables.build_record_table(raw), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SNK2", f"WITH {cte('recordid', 'species', 'elevation')} SELECT recordid, species, round(elevation, 4) AS elevation FROM occ")
def parquet_round_trip(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "species", "elevation")
    path = scratch_path(spark, "parquet")
    sinks.write_parquet(df, path)
    return spark.read.schema(df.schema).parquet(path).select("recordid", "species", F.round("elevation", 4).alias("elevation"))


@query("SNK3", f"WITH {cte('datasetkey')} SELECT datasetkey, count(*) AS n FROM occ GROUP BY 1")
def avro_round_trip(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "datasetkey", "recordedby", "eventdategte")
    rows = layouts.project_avro(df, ["datasetkey", "recordedby", "eventdategte"])
    path = scratch_path(spark, "avro")
    fmt = sinks.write_avro(rows, path, fallback="orc")
    return spark.read.format(fmt).schema(rows.schema).load(path).groupBy("datasetkey").agg(F.count("*").alias("n"))


@query("SNK4", f"WITH {DNA_CTE}, f AS (SELECT '>' || coalesce(nucleotidesequenceid, '') || '|' || recordid || '|' || coalesce(targetgene_concept, '') AS head,"
               " sequence FROM dna WHERE sequence IS NOT NULL) SELECT head AS line FROM f UNION ALL SELECT sequence FROM f")
def fasta_lines(spark, sf_dir):
    from sightings.functions.text import fasta

    rows = dna(spark, sf_dir).filter("sequence IS NOT NULL").select(
        fasta(F.col("nucleotidesequenceid"), F.col("recordid"), F.col("targetgene.concept"), F.col("sequence")).alias("fasta"))
    path = scratch_path(spark, "fasta")
    sinks.write_fasta(rows, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SNK5", "SELECT 'occurrence' AS \"table\", count(*) AS \"rows\", 2 AS columns FROM lineitem UNION ALL SELECT 'event', count(*), 2 FROM events")
def bundle_manifest(spark, sf_dir):
    frames = {"occurrence": sighting(spark, sf_dir, "recordid", "datasetkey"), "event": event(spark, sf_dir).select("eventid", "parenteventid")}
    return sinks.write_bundle(frames, scratch_path(spark, "bundle"))


# ---- layouts ----------------------------------------------------------------------------

_VERBATIM = [f"v_{n}" for n in terms.VERBATIM_TERMS]


@query("PRJ1", f"WITH {cte('recordid', *_VERBATIM, optional=('s',))} SELECT recordid, {', '.join(_VERBATIM)} FROM occ")
def verbatim_layout(spark, sf_dir):
    """A record without a supplier stays: only the identifying person comes from there."""
    return layouts.project_verbatim(sighting(spark, sf_dir, "recordid", *_VERBATIM, optional=("s",)))


_ISSUES = "concat_ws(';', issue_1, issue_2, taxonissue_1) AS issue"


@query("PRJ2", _rows("datasetkey kingdom family species taxonrank eventdategte dateidentified modified sex_concept typestatus_text recordedby_1 recordedby_2 issue_1 issue_2 taxonissue_1 month elevation",
                     f"datasetkey, kingdom, family, species, {_ISSUES}, CASE WHEN taxonrank = 'GENUS' THEN 'DOUBTFUL' ELSE 'ACCEPTED' END AS taxonomicstatus,"
                     f" {_UTC.format('eventdategte')} AS eventdategte, {_UTC.format('dateidentified')} AS dateidentified, {_MILLIS} AS modified,"
                     " sex_concept AS sex, typestatus_text AS typestatus, concat_ws(';', recordedby_1, recordedby_2) AS recordedby,"
                     " coalesce(month, -1) AS month, elevation"))
def interpreted_layout(spark, sf_dir):
    wanted = "datasetkey kingdom family species issue taxonomicstatus eventdategte dateidentified modified sex typestatus recordedby month elevation".split()
    df = sighting(spark, sf_dir, "recordid", "datasetkey", "classificationdetails", "taxonomicstatuses", "nontaxonomicissue", "taxonomicissue",
                    "eventdategte", "dateidentified", "modified", "sex", "typestatus", "recordedby", "month", "elevation")
    rows = layouts.project_interpreted(df, "cl-1", wanted)
    return rows.withColumn("month", F.coalesce("month", F.lit(-1)))


@query("PRJ3", f"WITH {EVENT_CTE} SELECT eventid, parenteventid, datasetkey, samplingprotocol, {_UTC.format('eventdategte')} AS eventdategte,"
               f" {_UTC.format('eventdatelte')} AS eventdatelte FROM ev")
def event_layout(spark, sf_dir):
    wanted = ["eventid", "parenteventid", "datasetkey", "samplingprotocol", "eventdategte", "eventdatelte"]
    return layouts.project_interpreted_event(event(spark, sf_dir), wanted)


@query("PRJ4", _rows("eventdategte modified sex_concept recordedby_1 recordedby_2 kingdom",
                     f"{_UTC.format('eventdategte')} AS eventdategte, {_MILLIS} AS modified, sex_concept AS sex,"
                     " to_json(list_filter([recordedby_1, recordedby_2], lambda x: x IS NOT NULL)) AS recordedby, kingdom"))
def avro_layout(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "eventdategte", "modified", "sex", "recordedby", "kingdom")
    rows = layouts.project_avro(df, ["eventdategte", "modified", "sex", "recordedby", "kingdom"])
    return rows.withColumn("recordedby", F.to_json("recordedby"))


@query("PRJ5", _rows("eventdategte modified sex_concept typestatus_text recordedby_1 recordedby_2 v_locality",
                     "strftime(to_timestamp(eventdategte) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS eventdategte,"
                     " CAST(epoch_ms(CAST(modified AS BIGINT)) AS VARCHAR) AS modified, sex_concept AS sex,"
                     " typestatus_text AS typestatus, concat_ws(';', recordedby_1, recordedby_2) AS recordedby, v_locality AS verbatimlocality"))
def parquet_layout(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "eventdategte", "modified", "sex", "typestatus", "recordedby", "v_locality")
    rows = layouts.project_parquet(df, ["eventdategte", "modified", "sex", "typestatus", "recordedby"], ["locality"])
    return rows.select("recordid", F.col("eventdategte").cast("string").alias("eventdategte"), F.col("modified").cast("string").alias("modified"),
                       "sex", F.array_join("typestatus", ";").alias("typestatus"), F.array_join("recordedby", ";").alias("recordedby"), "verbatimlocality")


@query("PRJ6", _rows("kingdom family genus species", "kingdom, family, genus, species, 'Order ' || family AS \"order\", CAST(NULL AS VARCHAR) AS phylum"))
def taxonomic_layout(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "classificationdetails")
    return layouts.project_taxonomic(df, "cl-1", ["kingdom", "family", "genus", "species", "order", "phylum"])


@query("PRJ7", f"WITH {HUMBOLDT_CTE} SELECT recordid, usagename AS targettaxonomicscope, family, CAST(NULL AS VARCHAR) AS genus FROM hum")
def taxonomic_list_layout(spark, sf_dir):
    return layouts.project_taxonomic_list(humboldt(spark, sf_dir), "cl-1", "targettaxonomicscope",
                                          {"targettaxonomicscope": "usagename", "family": "family", "genus": "genus"})


@query("PRJ8", _rows("datasetkey species v_scientificname v_year sex_concept", "datasetkey, species, v_scientificname, sex_concept AS sex, v_year"))
def grouped_layout(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "datasetkey", "classificationdetails", "v_scientificname", "v_year", "sex")
    return layouts.project_grouped(df, terms.grouped(["datasetkey", "species", "v:scientificname", "sex", "v:year"]), "cl-1")


def _select_from(wanted: list[str], known: dict[str, str]) -> str:
    return ", ".join(f'{known.get(w, "CAST(NULL AS VARCHAR)")} AS "{w}"' for w in wanted)


# layout column -> DuckDB value over the record columns, for the wide layouts
_WIDE = {
    **{n: n for n in "datasetkey occurrenceid kingdom family genus species taxonrank scientificname countrycode locality occurrencestatus"
       " individualcount publishingorgkey decimallatitude decimallongitude coordinateuncertaintyinmeters elevation depth year taxonkey"
       " specieskey basisofrecord institutioncode collectioncode catalognumber recordnumber license hascoordinate eventtime"
       " eventdate v_scientificname v_locality v_eventdate".split()},
    "month": "CAST(month AS INT)", "day": "CAST(day AS INT)",
    "recordedby": "concat_ws(';', recordedby_1, recordedby_2)", "identifiedby": "concat_ws(';', identifiedby_1)",
    "typestatus": "typestatus_text", "dateidentified": _UTC.format("dateidentified"), "eventdategte": _UTC.format("eventdategte"),
    "issue": "concat_ws(';', issue_1, issue_2, taxonissue_1)",
}
_WIDE_SOURCES = ("datasetkey occurrenceid kingdom family genus species taxonrank scientificname countrycode locality occurrencestatus individualcount"
                 " publishingorgkey decimallatitude decimallongitude coordinateuncertaintyinmeters elevation depth year month day taxonkey specieskey"
                 " basisofrecord institutioncode collectioncode catalognumber recordnumber license hascoordinate eventtime eventdate v_scientificname"
                 " v_locality v_eventdate recordedby_1 recordedby_2 identifiedby_1 typestatus_text dateidentified eventdategte issue_1 issue_2 taxonissue_1")


def _wide(spark, sf_dir):
    return sighting(spark, sf_dir, "recordid", *[c for c in _WIDE_SOURCES.split() if c[-2:] not in ("_1", "_2") and c != "typestatus_text"],
                      "recordedby", "identifiedby", "typestatus", "issue")


def _flat(df):
    """Arrays as text and missing numbers as text, so both engines print the same."""
    columns = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if field.dataType.typeName() == "array":
            c = F.array_join(c, ";")
        columns.append(c.alias(field.name))
    return df.select(*columns)


# the columns of the simple terms that the table has as they are, and what DuckDB shows for all terms; numbers that may be missing show -1
_SIMPLE_STORED = [n for n in terms.SIMPLE_TERMS if n in RECORD]
_SIMPLE_WIDE = {
    **_WIDE, **{n: n for n in _VERBATIM}, "mediatype": "array_to_string(mediatype, ';')",
    "month": "coalesce(CAST(month AS INT), -1)", "day": "coalesce(CAST(day AS INT), -1)",
    **{n: "CAST(NULL AS DOUBLE)" for n in ("coordinateprecision", "elevationaccuracy", "depthaccuracy")},
}


@query("PRJ9", _rows(f"{_WIDE_SOURCES} mediatype {' '.join(n for n in _VERBATIM if n not in _WIDE_SOURCES.split())}",
                     _select_from([*terms.SIMPLE_TERMS, *_VERBATIM], _SIMPLE_WIDE)))
def simple_with_verbatim_layout(spark, sf_dir):
    rows = layouts.project_simple_with_verbatim(sighting(spark, sf_dir, "recordid", *_SIMPLE_STORED, *_VERBATIM))
    return _flat(rows.withColumns({n: F.coalesce(n, F.lit(-1)) for n in ("month", "day")}))


_RANGE_SHOWN = [n.replace("v:", "v_") for n in terms.MAP_OF_LIFE_TERMS if n != "recordid"]
_RANGE_SHOWN = [n for n in _RANGE_SHOWN if n in _WIDE and n not in ("month", "day")]


@query("PRJ10", _rows(_WIDE_SOURCES, _select_from(_RANGE_SHOWN, _WIDE)))
def map_of_life_layout(spark, sf_dir):
    return _flat(layouts.project_map_of_life(_wide(spark, sf_dir)).select("recordid", *_RANGE_SHOWN))


@query("PRJ11", f"WITH {DNA_CTE} SELECT recordid, nucleotidesequenceid, sequence, coalesce(sequencelength, -1) AS sequencelength, targetgene_concept AS targetgene FROM dna")
def dna_layout(spark, sf_dir):
    return layouts.project_dna(dna(spark, sf_dir)).withColumn("sequencelength", F.coalesce("sequencelength", F.lit(-1)))


@query("PRJ12", _MEDIA_SQL.replace(" m.created AS created, m.creator AS creator", " m.created AS created, m.creator AS creator,"
                                   " CAST(NULL AS VARCHAR) AS references, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS source,"
                                   " CAST(NULL AS VARCHAR) AS audience, CAST(NULL AS VARCHAR) AS contributor, CAST(NULL AS VARCHAR) AS publisher,"
                                   " CAST(NULL AS VARCHAR) AS \"rightsHolder\"").replace(" AS references", " AS \"references\""))
def multimedia_layout(spark, sf_dir):
    return layouts.project_multimedia(tables.build_multimedia_table(sighting(spark, sf_dir, "recordid", "ext_multimedia")))


@query("PRJ13", f"WITH {cte('recordid', 'decimallatitude', 'decimallongitude', 'countrycode', 'publishingcountry', 'recordedby_1', 'recordedby_2', 'ext_multimedia')}"
                " SELECT recordid, decimallatitude IS NOT NULL AND decimallongitude IS NOT NULL AS hascoordinate, countrycode <> publishingcountry AS repatriated,"
                " coalesce(array_to_string(regexp_extract_all(ext_multimedia, '\"type\":\"([A-Za-z]+)\"', 1), ';'), 'none') AS mediatype,"
                " concat_ws(';', recordedby_1, recordedby_2) AS recordedby FROM occ")
def derived_flags(spark, sf_dir):
    from sightings.functions.text import media_items

    df = sighting(spark, sf_dir, "recordid", "decimallatitude", "decimallongitude", "countrycode", "publishingcountry", "recordedby", "ext_multimedia")
    rows = layouts.derive_flags(df.withColumn("media", media_items(F.col("ext_multimedia"))))
    return rows.withColumn("mediatype", F.coalesce("mediatype", F.lit("none")))


@query("PRJ14", f"WITH {cte('recordid', 'datasetkey', 'month', 'dateidentified', 'modified', 'recordedby', 'collectioncode')}"
                " SELECT 'recordid' AS name, 'STRING' AS type, CAST(NULL AS VARCHAR) AS typeformat, CAST(NULL AS VARCHAR) AS delimiter, count(recordid) < count(*) AS nullable FROM occ"
                " UNION ALL SELECT 'datasetkey', 'STRING', NULL, NULL, count(datasetkey) < count(*) FROM occ"
                " UNION ALL SELECT 'month', 'INT', NULL, NULL, count(month) < count(*) FROM occ"
                " UNION ALL SELECT 'dateidentified', 'DATE', 'yyyy-MM-ddTHH:mm:ss', NULL, count(dateidentified) < count(*) FROM occ"
                " UNION ALL SELECT 'modified', 'DATE', 'yyyy-MM-ddTHH:mm:ss.SSSZ', NULL, count(modified) < count(*) FROM occ"
                " UNION ALL SELECT 'recordedby', 'ARRAY<STRING>', NULL, ';', count(recordedby) < count(*) FROM occ"
                " UNION ALL SELECT 'collectioncode', 'STRING', NULL, NULL, count(collectioncode) < count(*) FROM occ")
def layout_description(spark, sf_dir):
    names = ["datasetkey", "month", "dateidentified", "modified", "recordedby", "collectioncode"]
    return layouts.describe_layout(sighting(spark, sf_dir, "recordid", *names), names)


@query("PRJ15", _rows("datasetkey occurrenceid institutioncode collectioncode catalognumber",
                      "CASE WHEN occurrenceid IS NOT NULL THEN datasetkey || '|' || occurrenceid"
                      " ELSE datasetkey || '|' || institutioncode || '|' || collectioncode || '|' || catalognumber || '|null' END AS uniquekey"))
def unique_keys(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "datasetkey", "occurrenceid", "institutioncode", "collectioncode", "catalognumber")
    return df.select("recordid", layouts.record_key(df).alias("uniquekey"))
