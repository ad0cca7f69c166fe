"""Filters: one query per predicate kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings import model as m
from sightings.catalog.registry import query
from sightings.functions import text
from sightings.operators import params as request
from sightings.operators.geologic import CHRONOSTRATIGRAPHY, GeologicTime
from sightings.operators.names import match_names
from sightings.operators.paging import by_id, by_record
from sightings.operators.predicates import Filters, filter_in, having_child, keep_listed
from sightings.plans.quality import cube_quality
from sightings.sources.driver import EVENT_CTE, cte, event, sighting, table

RECORDS = Filters()
EVENTS = Filters(m.EVENT_FIELDS)


def _ids(df: DataFrame) -> DataFrame:
    return df.select("recordid")


def _sql(columns: str, where: str) -> str:
    names = list(dict.fromkeys(["recordid", *columns.split()]))
    return f"WITH {cte(*names)} SELECT recordid FROM occ WHERE {where}"


def _apply(spark: SparkSession, sf_dir: str, columns: str, predicate: dict | None) -> DataFrame:
    names = list(dict.fromkeys(["recordid", *columns.split()]))
    return _ids(RECORDS.apply(sighting(spark, sf_dir, *names), predicate))


@query("FLT1", _sql("species", "lower(species) = 'red widget'"))
def equals_any_case(spark, sf_dir):
    return _apply(spark, sf_dir, "species classificationdetails", {"type": "equals", "key": "SPECIES", "value": "RED Widget"})


@query("FLT2", _sql("institutioncode", "institutioncode = 'INST-7'"))
def equals_match_case(spark, sf_dir):
    return _apply(spark, sf_dir, "institutioncode",
                  {"type": "equals", "key": "INSTITUTION_CODE", "value": "INST-7", "matchCase": True})


@query("FLT3", _sql("eventdategte", "eventdategte >= epoch(TIMESTAMP '1997-02-01') AND eventdategte < epoch(TIMESTAMP '1997-03-01')"))
def equals_date_of_month(spark, sf_dir):
    return _apply(spark, sf_dir, "eventdategte", {"type": "equals", "key": "EVENT_DATE_GTE", "value": "1997-2"})


@query("FLT4", _sql("elevation year", "elevation >= 300.5 AND elevation <= 450 AND year >= 1999"))
def equals_numeric_range(spark, sf_dir):
    return _apply(spark, sf_dir, "elevation year", {"type": "and", "predicates": [
        {"type": "equals", "key": "ELEVATION", "value": "300.5,450"},
        {"type": "equals", "key": "YEAR", "value": "1999,*"}]})


@query("FLT5", _sql("eventdategte eventdatelte", "eventdategte >= epoch(TIMESTAMP '1998-02-01') AND eventdatelte < epoch(TIMESTAMP '1998-09-17')"))
def date_range_within(spark, sf_dir):
    return _apply(spark, sf_dir, "eventdategte eventdatelte",
                  {"type": "equals", "key": "EVENT_DATE", "value": "1998-02,1998-09-16"})


@query("FLT6", _sql("elevation year eventdategte month",
                    "elevation > 500 AND elevation < 700 AND year >= 1997 AND month <= 6 AND eventdategte < epoch(TIMESTAMP '2000-01-01')"))
def comparisons(spark, sf_dir):
    return _apply(spark, sf_dir, "elevation year eventdategte month", {"type": "and", "predicates": [
        {"type": "greaterThan", "key": "ELEVATION", "value": "500"},
        {"type": "lessThan", "key": "ELEVATION", "value": "700"},
        {"type": "greaterThanOrEquals", "key": "YEAR", "value": "1997"},
        {"type": "lessThanOrEquals", "key": "MONTH", "value": "6"},
        {"type": "lessThan", "key": "EVENT_DATE_GTE", "value": "2000"}]})


@query("FLT7", _sql("year basisofrecord occurrencestatus",
                    "(year = 1998 OR (basisofrecord = 'HUMAN_OBSERVATION' AND occurrencestatus = 'ABSENT')) AND year < 2000"))
def and_or_nested(spark, sf_dir):
    return _apply(spark, sf_dir, "year basisofrecord occurrencestatus", {"type": "and", "predicates": [
        {"type": "or", "predicates": [
            {"type": "equals", "key": "YEAR", "value": "1998"},
            {"type": "and", "predicates": [
                {"type": "equals", "key": "BASIS_OF_RECORD", "value": "HUMAN_OBSERVATION"},
                {"type": "equals", "key": "OCCURRENCE_STATUS", "value": "ABSENT"}]}]},
        {"type": "lessThan", "key": "YEAR", "value": "2000"}]})


@query("FLT8", _sql("datasetkey taxonkey", "datasetkey IN ('ds-1', 'ds-5') OR taxonkey IN (SELECT CAST(p_partkey AS STRING) FROM part WHERE p_size < 25)"))
def in_lists(spark, sf_dir):
    """A short literal list, and a key list of any length as a semi join."""
    df = sighting(spark, sf_dir, "recordid", "datasetkey", "taxonkey")
    short = filter_in(df, F.col("datasetkey"), ["DS-1", "ds-5"])
    keys = table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").cast("string").alias("key"))
    rest = df.filter(~F.lower("datasetkey").isin("ds-1", "ds-5"))
    return _ids(short.unionByName(keep_listed(rest, F.col("taxonkey"), keys)))


@query("FLT9", _sql("collectioncode institutioncode year recordedby_1 recordedby_2",
                    "NOT (collectioncode = 'COLL-1' AND institutioncode = 'INST-1') AND collectioncode IS NOT NULL"
                    " AND NOT coalesce(lower(recordedby_1) = 'customer#000000007', false)"
                    " AND NOT coalesce(lower(recordedby_2) = 'customer#000000007', false)"
                    " AND (recordedby_1 IS NOT NULL OR recordedby_2 IS NOT NULL)"))
def negation_needs_the_fields(spark, sf_dir):
    return _apply(spark, sf_dir, "collectioncode institutioncode recordedby", {"type": "and", "predicates": [
        {"type": "not", "predicate": {"type": "and", "predicates": [
            {"type": "equals", "key": "COLLECTION_CODE", "value": "coll-1"},
            {"type": "equals", "key": "INSTITUTION_CODE", "value": "inst-1"}]}},
        {"type": "not", "predicate": {"type": "equals", "key": "RECORDED_BY", "value": "Customer#000000007"}}]})


@query("FLT10", _sql("locality species", "regexp_matches(locality, '^Plot .5$') OR regexp_matches(lower(species), '^red.*t$')"))
def like_wildcards(spark, sf_dir):
    return _apply(spark, sf_dir, "locality classificationdetails", {"type": "or", "predicates": [
        {"type": "like", "key": "LOCALITY", "value": "Plot ?5", "matchCase": True},
        {"type": "like", "key": "SPECIES", "value": "RED*T"}]})


@query("FLT11", _sql("collectioncode issue_1 issue_2 taxonissue_1",
                     "collectioncode IS NULL OR (issue_1 IS NULL AND issue_2 IS NULL AND taxonissue_1 IS NULL)"))
def missing_values(spark, sf_dir):
    return _apply(spark, sf_dir, "collectioncode issue", {"type": "or", "predicates": [
        {"type": "isNull", "key": "COLLECTION_CODE"},
        {"type": "not", "predicate": {"type": "isNotNull", "key": "ISSUE"}}]})


@query("FLT12", _sql("sex_root typestatus_text", "sex_root = 'P' AND typestatus_text IS NOT NULL"))
def vocabulary_lineage(spark, sf_dir):
    return _apply(spark, sf_dir, "sex typestatus", {"type": "and", "predicates": [
        {"type": "equals", "key": "SEX", "value": "p"},
        {"type": "equals", "key": "TYPE_STATUS", "value": "Type"}]})


@query("FLT13", _sql("issue_1 issue_2 taxonissue_1 recordedby_1 recordedby_2",
                     "NOT coalesce(issue_1 = 'ZERO_COORDINATE', false)"
                     " AND (coalesce(lower(recordedby_1) = 'customer#000000010', false) OR coalesce(lower(recordedby_2) = 'customer#000000010', false)"
                     " OR coalesce(taxonissue_1 = 'TAXON_MATCH_FUZZY', false))"))
def array_contains_never_null(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "issue", "recordedby")
    return _ids(df.filter(
        ~text.array_contains_text(F.col("issue"), "ZERO_COORDINATE", True)
        & (text.array_contains_text(F.col("recordedby"), "CUSTOMER#000000010", False)
           | text.array_contains_text(F.col("issue"), "TAXON_MATCH_FUZZY", True))))


@query("FLT14", _sql("recordedby_1 recordedby_2",
                     "coalesce(regexp_matches(recordedby_1, '^Customer#0*[0-9]7$'), false) OR coalesce(regexp_matches(recordedby_2, '^(?i)supplier#0000000.1$'), false)"))
def array_like(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "recordedby")
    people = F.col("recordedby")
    return _ids(df.filter(text.array_like_text(people, "Customer#0000000?7", True)
                          | text.array_like_text(people, "SUPPLIER#0000000?1", False)))


@query("FLT15", _sql("issue_2 taxonissue_1", "issue_2 IS NOT NULL OR taxonissue_1 IS NOT NULL"))
def arrays_overlap(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "issue")
    return _ids(df.filter(F.arrays_overlap("issue", F.array(F.lit("COUNTRY_COORDINATE_MISMATCH"), F.lit("TAXON_MATCH_FUZZY")))))


@query("FLT16", _sql("kingdom family specieskey", "family = 'Brand#7' OR specieskey = '11'"))
def taxon_through_checklist(spark, sf_dir):
    return _apply(spark, sf_dir, "taxonkeys", {"type": "in", "key": "TAXON_KEY", "values": ["Brand#7", "11"], "checklistKey": "cl-1"})


@query("FLT17", _sql("kingdom family", "kingdom = 'PROMO' OR family = 'Brand#3'"))
def any_rank_key(spark, sf_dir):
    return _apply(spark, sf_dir, "taxonkeys", {"type": "or", "predicates": [
        {"type": "equals", "key": "KINGDOM_KEY", "value": "PROMO", "checklistKey": "cl-2"},
        {"type": "equals", "key": "TRIBE_KEY", "value": "Brand#3"}]})


@query("FLT18", _sql("issue_1 issue_2", "issue_1 = 'ZERO_COORDINATE' OR issue_2 = 'COUNTRY_COORDINATE_MISMATCH'"))
def issues_of_a_checklist(spark, sf_dir):
    wanted = ["ZERO_COORDINATE", "COUNTRY_COORDINATE_MISMATCH"]
    RECORDS.check_issues({"type": "in", "key": "ISSUE", "values": wanted}, ["TAXON_MATCH_FUZZY", "TAXON_MATCH_NONE"])
    df = sighting(spark, sf_dir, "recordid", "nontaxonomicissue")
    return _ids(df.filter(F.arrays_overlap("nontaxonomicissue", F.array(*map(F.lit, wanted)))))


@query("FLT19", _sql("distancefromcentroidinmeters year",
                     "(distancefromcentroidinmeters >= 5000 OR distancefromcentroidinmeters IS NULL) AND year = 1999"))
def null_inclusive_range(spark, sf_dir):
    return _apply(spark, sf_dir, "distancefromcentroidinmeters year", {"type": "and", "predicates": [
        {"type": "equals", "key": "DISTANCE_FROM_CENTROID_IN_METERS", "value": "5000,*"},
        {"type": "equals", "key": "YEAR", "value": "1999"}]})


_AGES = ", ".join(f"('{c}', {s}, {e})" for c, s, e in CHRONOSTRATIGRAPHY)


@query("FLT20", f"WITH {cte('recordid', 'geologicaltime_gt', 'geologicaltime_lte')},"
                f" ages(concept, start_age, end_age) AS (VALUES {_AGES})"
                " SELECT recordid FROM occ, (SELECT min(end_age) AS lo, max(start_age) AS hi FROM ages WHERE concept IN ('mesozoic', 'cenozoic')) r,"
                " (SELECT start_age, end_age FROM ages WHERE concept = 'jurassic') j"
                " WHERE geologicaltime_gt >= r.lo AND geologicaltime_lte <= r.hi"
                " AND NOT (geologicaltime_gt >= j.end_age AND geologicaltime_lte <= j.start_age) AND geologicaltime_gt >= 66")
def geological_time(spark, sf_dir):
    filters = Filters(geologic=GeologicTime())
    df = sighting(spark, sf_dir, "recordid", "geologicaltime")
    return _ids(filters.apply(df, {"type": "and", "predicates": [
        {"type": "equals", "key": "GEOLOGICAL_TIME", "value": "cenozoic,mesozoic"},
        {"type": "not", "predicate": {"type": "equals", "key": "GEOLOGICAL_TIME", "value": "jurassic"}},
        {"type": "greaterThanOrEquals", "key": "GEOLOGICAL_TIME", "value": "mesozoic"}]}))


@query("FLT21", f"WITH {EVENT_CTE} SELECT eventid FROM ev WHERE (h1_duration BETWEEN 120 AND 300) OR (h2_duration BETWEEN 120 AND 300)")
def humboldt_duration(spark, sf_dir):
    predicate = request.search_predicate(request.with_duration({"HUMBOLDT_EVENT_DURATION": ["2 hours,300 minutes"]}), m.EVENT_FIELDS)
    return EVENTS.apply(event(spark, sf_dir), predicate).select("eventid")


@query("FLT22", f"WITH {EVENT_CTE} SELECT eventid FROM ev WHERE (h1_duration >= 100 AND h1_inventory = 'restricted')"
                " OR (h2_duration >= 100 AND h2_inventory = 'restricted')")
def same_element(spark, sf_dir):
    return EVENTS.apply(event(spark, sf_dir), {"type": "and", "predicates": [
        {"type": "greaterThanOrEquals", "key": "HUMBOLDT_EVENT_DURATION_VALUE_IN_MINUTES", "value": "100"},
        {"type": "equals", "key": "HUMBOLDT_INVENTORY_TYPES", "value": "Restricted"}]}).select("eventid")


@query("FLT23", f"WITH {EVENT_CTE}, {cte('eventid', 'basisofrecord', 'year')} SELECT eventid FROM ev WHERE type = 'event' AND eventid IN"
                " (SELECT eventid FROM occ WHERE basisofrecord = 'PRESERVED_SPECIMEN' AND year = 1996)")
def events_having_records(spark, sf_dir):
    children = RECORDS.apply(sighting(spark, sf_dir, "eventid", "basisofrecord", "year"), {"type": "and", "predicates": [
        {"type": "equals", "key": "BASIS_OF_RECORD", "value": "PRESERVED_SPECIMEN"}, {"type": "equals", "key": "YEAR", "value": "1996"}]})
    return having_child(event(spark, sf_dir).filter("type = 'event'"), children, ["eventid"]).select("eventid")


@query("FLT24", _sql("datasetkey year elevation collectioncode decimallatitude decimallongitude",
                     "datasetkey IN ('ds-1', 'ds-2', 'ds-3') AND ((year >= 1995 AND year <= 1997) OR year = 2000)"
                     " AND elevation >= 200 AND collectioncode IS NOT NULL"))
def export_parameters(spark, sf_dir):
    predicate = request.export_predicate({
        "dataset_key": ["ds-1", "ds-2", "ds-3"], "year": ["1995,1997", "2000"], "elevation": ["200,*"],
        "collection_code": ["*"], "unknown_one": ["x"]})
    return _apply(spark, sf_dir, "datasetkey year elevation collectioncode", predicate)


@query("FLT25", _sql("institutioncode", "institutioncode IN ('INST-1', 'INST-2', 'INST-3')"))
def or_of_equals_is_in(spark, sf_dir):
    return _apply(spark, sf_dir, "institutioncode", {"type": "or", "predicates": [
        {"type": "equals", "key": "INSTITUTION_CODE", "value": f"inst-{n}"} for n in (1, 2, 3)]})


@query("FLT26", _sql("taxonkey species specieskey", "specieskey IN (SELECT CAST(p_partkey AS STRING) FROM part WHERE p_name = 'red widget')"))
def scientific_name_to_keys(spark, sf_dir):
    backbone = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("scientificname"), F.col("p_partkey").cast("string").alias("usagekey"),
        F.lit(None).cast("string").alias("acceptedkey"))
    df = sighting(spark, sf_dir, "recordid", "taxonkeys")
    return _ids(match_names(df, backbone, ["Red Widget"], checklist="cl-1"))


@query("FLT27", f"WITH {EVENT_CTE} SELECT eventid, eventtype FROM ev WHERE type = 'event'")
def events_only(spark, sf_dir):
    return event(spark, sf_dir).filter("type = 'event'").select("eventid", "eventtype")


@query("FLT28", _sql("occurrencestatus hascoordinate coordinateuncertaintyinmeters year month specieskey issue_1 issue_2",
                     "occurrencestatus = 'PRESENT' AND hascoordinate AND (coordinateuncertaintyinmeters <= 1000 OR coordinateuncertaintyinmeters IS NULL)"
                     " AND year >= 1996 AND month IS NOT NULL AND specieskey IS NOT NULL AND issue_1 IS NULL AND issue_2 IS NULL"))
def data_cube_quality(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "occurrencestatus", "hascoordinate", "coordinateuncertaintyinmeters",
                    "year", "month", "specieskey", "issue")
    return _ids(df.filter(cube_quality(1000, 1996)))


_POINT = "WITH " + cte("recordid", "datasetkey", "occurrenceid", "v_locality") + (
    ", k AS (SELECT min((datasetkey, occurrenceid)) AS k FROM occ WHERE occurrenceid IS NOT NULL),"
    " m AS (SELECT max(recordid) AS m FROM occ)"
    " SELECT recordid, v_locality FROM occ, m WHERE recordid = m UNION ALL"
    " SELECT min(recordid), arg_min(v_locality, recordid) FROM occ, k WHERE (datasetkey, occurrenceid) = k")


@query("FLT29", _POINT)
def point_lookups(spark, sf_dir):
    """One record by id and one by (dataset, record id of the publisher), verbatim form."""
    df = sighting(spark, sf_dir, "recordid", "datasetkey", "occurrenceid", "v_locality")
    named = df.filter("occurrenceid IS NOT NULL")
    last = df.agg(F.max("recordid").alias("recordid"), F.lit(1)).first().recordid
    dataset, name = named.agg(F.min(F.struct("datasetkey", "occurrenceid")).alias("k")).first().k
    return by_id(df, last).unionByName(by_record(df, dataset, name)).select("recordid", "v_locality")


@query("FLT30", _sql("year month countrycode",
                     "((year >= 1995 AND year <= 1996) OR (year >= 1999 AND year <= 2001)) AND year IN (1995, 1999, 2000) AND countrycode IN ('NATION_3', 'NATION_4')"))
def search_parameters(spark, sf_dir):
    predicate = request.search_predicate({"YEAR": ["1995,1996", "1999,2001", "1995", "1999", "2000"], "COUNTRY": ["nation_3", "nation_4"]})
    return _apply(spark, sf_dir, "year countrycode", predicate)


