"""Export jobs, written to the shared folder and summarised."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightings.catalog.registry import query
from sightings.plans import exports, layouts
from sightings.plans.user_sql import sql_export
from sightings.session import scratch_path, staged
from sightings.sources import sinks
from sightings.sources.driver import DNA_CTE, EVENT_CTE, HUMBOLDT_CTE, cte, dna, event, humboldt, sighting
from sightings.sources.tables import build_multimedia_table, build_record_table

_SIMPLE = (
    "recordid datasetkey license occurrenceid classificationdetails taxonomicissue nontaxonomicissue issue countrycode locality occurrencestatus"
    " individualcount publishingorgkey decimallatitude decimallongitude coordinateuncertaintyinmeters elevation depth eventdate day month year"
    " taxonkey specieskey basisofrecord institutioncode collectioncode catalognumber recordnumber identifiedby dateidentified recordedby typestatus"
    " mediatype v_scientificname v_locality v_eventdate kingdom family"
).split()
_WHERE = "year = 1999 AND countrycode <> 'NATION_1'"


def _where():
    return F.expr(_WHERE)


def _manifest(tables, spark, fmt: str = "parquet"):
    return exports.write_export(tables, scratch_path(spark, "export"), fmt)


def _manifest_sql(with_ctes: str, *tables: tuple[str, str, int]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{name}' AS \"table\", (SELECT count(*) FROM ({sql})) AS \"rows\", {columns} AS columns" for name, sql, columns in tables)
    return f"WITH {with_ctes}, kept AS (SELECT * FROM occ WHERE {_WHERE}) {rows}"


def _simple_sql(columns: int) -> str:
    return _manifest_sql(
        cte("recordid", "datasetkey", "license", "year", "countrycode"), ("result", "SELECT * FROM kept", columns),
        ("citation", "SELECT DISTINCT datasetkey, license FROM kept", 3), ("count", "SELECT 1", 1))


@query("EXP1", _simple_sql(50))
def simple_text_export(spark, sf_dir):
    df = build_record_table(sighting(spark, sf_dir, *_SIMPLE))
    return _manifest(exports.simple_text(df, _where(), "cl-1"), spark, "tsv")


def _archive(spark, sf_dir):
    names = [*_SIMPLE, "publishingcountry", "eventid", "eventtime", "sex", "lifestage", "taxonomicstatuses", "modified", "eventdategte", "eventdatelte",
             "hascoordinate", "v_country", "v_year", "v_recordedby", "ext_multimedia"]
    df = sighting(spark, sf_dir, *names)
    # both extensions of all records come from one join of the tables
    extended = staged(df.select("recordid", "locality", "recordnumber", "ext_multimedia"), "extended", codec="zstd")
    remarks = extended.select("recordid", F.explode(F.array("locality", "recordnumber")).alias("remark"))
    return exports.full_archive(df, _where(), "cl-1", build_multimedia_table(extended), dna(spark, sf_dir), {"remarks": remarks})


@query("EXP2", _manifest_sql(
    f"{cte('recordid', 'datasetkey', 'license', 'year', 'countrycode', 'ext_multimedia')}, {DNA_CTE}",
    ("verbatim", "SELECT * FROM kept", 23), ("occurrence", "SELECT * FROM kept", 63),
    ("multimedia", "SELECT recordid, unnest(regexp_extract_all(ext_multimedia, '\"type\":')) FROM kept WHERE ext_multimedia IS NOT NULL", 15),
    ("citation", "SELECT DISTINCT datasetkey FROM kept", 2), ("dna", "SELECT * FROM dna WHERE recordid IN (SELECT recordid FROM kept)", 5),
    ("verbatim_remarks", "SELECT recordid, unnest([1, 2]) FROM kept", 2)))
def full_archive_export(spark, sf_dir):
    return _manifest(_archive(spark, sf_dir), spark)


@query("EXP3", _simple_sql(50))
def simple_avro_export(spark, sf_dir):
    return _manifest(exports.simple_avro(sighting(spark, sf_dir, *_SIMPLE), _where()), spark, sinks.export_format(spark, "avro", fallback="orc"))


@query("EXP4", _simple_sql(len(layouts.simple_with_verbatim_pairs()) + 1))
def simple_with_verbatim_export(spark, sf_dir):
    return _manifest(exports.simple_with_verbatim_avro(sighting(spark, sf_dir, *_SIMPLE), _where()), spark, sinks.export_format(spark, "avro", fallback="orc"))


@query("EXP5", _simple_sql(50))
def parquet_export(spark, sf_dir):
    return _manifest(exports.simple_parquet(sighting(spark, sf_dir, *_SIMPLE), _where()), spark)


@query("EXP6", _simple_sql(76))
def map_of_life_export(spark, sf_dir):
    return _manifest(exports.map_of_life(sighting(spark, sf_dir, *_SIMPLE), _where()), spark, "orc")


_PERSONS = ("recordid", "datasetkey", "license", "family", "v_recordedby", "v_identifiedby", "v_recordedbyid", "v_identifiedbyid", "year", "countrycode")


@query("EXP7", _manifest_sql(
    cte(*_PERSONS) + f", n AS (SELECT * FROM occ WHERE {_WHERE} AND (v_recordedby IS NOT NULL OR v_identifiedby IS NOT NULL))",
    ("result", "SELECT * FROM n", 11), ("citation", "SELECT DISTINCT datasetkey, license FROM n", 3),
    ("agents", "SELECT v_recordedby FROM n WHERE v_recordedby IS NOT NULL UNION SELECT v_identifiedby FROM n WHERE v_identifiedby IS NOT NULL", 6),
    ("families", "SELECT DISTINCT family FROM n", 4),
    ("identifiers", "SELECT v_recordedbyid FROM n WHERE v_recordedbyid IS NOT NULL UNION SELECT v_identifiedbyid FROM n WHERE v_identifiedbyid IS NOT NULL", 6)))
def person_export(spark, sf_dir):
    return _manifest(exports.person_export(sighting(spark, sf_dir, *_PERSONS, "mediatype"), _where()), spark)


_TAXON = ["taxonkey", "scientificname", "kingdom", "family", "genus", "species"]


@query("EXP8", _manifest_sql(
    cte(*_TAXON, "datasetkey", "license", "year", "countrycode"), ("result", f"SELECT DISTINCT {', '.join(_TAXON)} FROM kept", 7),
    ("citation", "SELECT DISTINCT datasetkey, license FROM kept", 3), ("count", "SELECT 1", 1)))
def species_export(spark, sf_dir):
    return _manifest(exports.species_export(sighting(spark, sf_dir, *_TAXON, "datasetkey", "license", "year", "countrycode"), _where(), _TAXON), spark)


@query("EXP9", f"WITH {cte('datasetkey', 'license', 'year', 'species', 'decimallatitude', 'decimallongitude')}, kept AS (SELECT * FROM occ WHERE year >= 1998),"
               " r AS (SELECT year, species, count(*) AS n FROM kept GROUP BY ALL)"
               " SELECT 'result' AS part, CAST(year AS VARCHAR) || '/' || species AS key, n FROM r UNION ALL SELECT 'count', 'rows', count(*) FROM r"
               " UNION ALL SELECT 'citation', datasetkey || '/' || license, count(*) FROM kept GROUP BY 2")
def user_sql_export(spark, sf_dir):
    views = {"occurrence": sighting(spark, sf_dir, "datasetkey", "license", "year", "species")}
    out = sql_export(spark, views, 'SELECT "year", species, COUNT(*) AS n FROM occurrence WHERE "year" >= 1998 GROUP BY "year", species;', where='"year" >= 1998')
    result = out["result"].select(F.lit("result").alias("part"), F.concat_ws("/", F.col("year").cast("string"), "species").alias("key"), "n")
    count = out["count"].select(F.lit("count").alias("part"), F.lit("rows").alias("key"), F.col("count").alias("n"))
    cited = out["citation"].select(F.lit("citation").alias("part"), F.concat_ws("/", "datasetkey", "license").alias("key"), F.col("num_occurrences").alias("n"))
    return result.unionByName(count).unionByName(cited)


@query("EXP10", _manifest_sql(
    f"{cte('recordid', 'datasetkey', 'year', 'countrycode')}, {DNA_CTE}, s AS (SELECT * FROM dna WHERE sequence IS NOT NULL)",
    ("occurrence", "SELECT * FROM kept WHERE recordid IN (SELECT recordid FROM s)", 4), ("fasta", "SELECT * FROM s WHERE recordid IN (SELECT recordid FROM kept)", 1),
    ("sequences", "SELECT * FROM s WHERE recordid IN (SELECT recordid FROM kept)", 5),
    ("citation", "SELECT DISTINCT datasetkey FROM kept WHERE recordid IN (SELECT recordid FROM s)", 2)))
def fasta_export(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "datasetkey", "year", "countrycode")
    return _manifest(exports.fasta_archive(df, _where(), dna(spark, sf_dir)), spark)


@query("EXP11", f"WITH {cte('recordid', 'year', 'countrycode')}, {DNA_CTE}, kept AS (SELECT * FROM occ WHERE {_WHERE})"
                " SELECT 'remarks' AS extension, recordid, 2 AS n FROM kept UNION ALL SELECT 'dna', recordid, count(*) FROM dna WHERE recordid IN (SELECT recordid FROM kept) GROUP BY 2")
def extensions_export(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "locality", "recordnumber", "year", "countrycode")
    remarks = df.select("recordid", F.explode(F.array("locality", "recordnumber")).alias("remark"))
    cut = exports.verbatim_extensions({"remarks": remarks, "dna": dna(spark, sf_dir)}, df.filter(_where()))
    counted = [rows.groupBy("recordid").agg(F.count("*").alias("n")).select(F.lit(name).alias("extension"), "recordid", "n") for name, rows in cut.items()]
    return counted[0].unionByName(counted[1])


@query("EXP12", "SELECT unnest(['same records verbatim and interpreted', 'citation counts per dataset', 'citation total', 'equal column count per line']) AS \"check\", count(*) > 0 AS holds FROM lineitem")
def archive_consistency(spark, sf_dir):
    """The checks of an archive, on the files written for it."""
    tables = _archive(spark, sf_dir)
    report = exports.consistency_report(tables["verbatim"], tables["occurrence"], tables["citation"])
    path = scratch_path(spark, "lines")
    text = build_record_table(tables["verbatim"])
    sinks.write_tsv(text, path)
    return report.unionByName(exports.column_count_report(spark.read.text(path), len(text.columns)))


@query("EXP2E", f"WITH {EVENT_CTE}, {HUMBOLDT_CTE}, {cte('recordid', 'eventid')}, kept AS (SELECT * FROM ev WHERE eventtype = 'view')"
                " SELECT 'event' AS \"table\", count(*) AS \"rows\", 4 AS columns FROM kept"
                " UNION ALL SELECT 'humboldt', count(*), 3 FROM hum WHERE recordid IN (SELECT eventid FROM kept)"
                " UNION ALL SELECT 'occurrence', count(*), 3 FROM occ WHERE eventid IN (SELECT eventid FROM kept)"
                " UNION ALL SELECT 'citation', count(DISTINCT datasetkey), 2 FROM kept")
def event_archive_export(spark, sf_dir):
    """The full archive with events as the core: inventories and the events' records."""
    records = sighting(spark, sf_dir, "recordid", "eventid").withColumn("datasetkey", F.lit("ds-e"))
    wanted = ["eventid", "parenteventid", "datasetkey", "eventdategte"]
    return _manifest(exports.event_archive(event(spark, sf_dir), F.col("eventtype") == "view", humboldt(spark, sf_dir), records, wanted), spark)
