"""Column types and the search fields of the record and event tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ID = "recordid"

# Kinds of search field; the kind decides how a filter or facet reads the column.
KEYWORD = "keyword"          # text compared without case
UPPER = "upper"              # vocabulary names, always stored in capitals
LOWER = "lower"              # keys, always stored in lower case
NUMBER = "number"
BOOLEAN = "boolean"
DATE = "date"                # epoch seconds
MILLIS = "millis"            # epoch milliseconds
INTERVAL = "interval"        # eventdategte .. eventdatelte, epoch seconds
ARRAY = "array"              # array<string>
VOCABULARY = "vocabulary"    # struct<concept, lineage>
VOCABULARY_ARRAY = "vocabulary_array"  # struct<concepts, lineage>
RANK = "rank"                # classificationdetails[checklist][rank]
ANCESTORS = "ancestors"      # taxonkeys[checklist], every ancestor key
STATUS = "status"            # map[checklist] -> string
STATUS_ARRAY = "status_array"  # map[checklist] -> array<string>
AGE_RANGE = "age_range"      # struct<gt, lte>, million years
NESTED = "nested"            # field of an array<struct>


@dataclass(frozen=True)
class Field:
    """One search parameter: the column it reads, how, and for nested arrays the element field."""

    column: str
    kind: str = KEYWORD
    element: str | None = None
    element_kind: str = KEYWORD
    suggest: bool = False
    null_inclusive: bool = False

    def col(self, checklist: str | None = None) -> Column:
        if self.kind == RANK:
            return F.col("classificationdetails").getItem(checklist).getItem(self.column)
        if self.kind in (ANCESTORS, STATUS, STATUS_ARRAY):
            return F.col(self.column).getItem(checklist)
        return F.col(self.column)


def _fields(kind: str, *names: str, **more) -> dict[str, Field]:
    return {name.upper(): Field(name.split(":")[-1].lower().replace("_", ""), kind, **more) for name in names}


# Search parameter names, by the kind of column they read.
RECORD_FIELDS: dict[str, Field] = {
    **_fields(UPPER, "license", "protocol", "publishing_country", "basis_of_record", "occurrence_status", "continent"),
    **_fields(LOWER, "dataset_key", "installation_key", "hosting_organization_key", "collection_key", "institution_key"),
    **_fields(KEYWORD, "project_id", "programme_acronym", "dataset_id", "coordinate_precision", "island",
              "island_group", "higher_geography", "georeferenced_by", "taxon_id", "taxon_concept_id",
              "verbatim_scientific_name", "previous_identifications",
              "field_number", "lowest_biostratigraphic_zone", "highest_biostratigraphic_zone", "group",
              "formation", "member", "bed", "associated_sequences", "organism_quantity_type",
              "sample_size_unit", "crawl_id", "dna_sequence_id"),
    **_fields(KEYWORD, "institution_code", "collection_code", "catalog_number", "organism_id",
              "occurrence_id", "record_number", "dataset_name", "other_catalog_numbers", "preparations",
              "state_province", "water_body", "locality", "event_id", "parent_event_id",
              "sampling_protocol", "lithostratigraphy", "biostratigraphy", suggest=True),
    **_fields(NUMBER, "decimal_latitude", "decimal_longitude", "year", "month", "day",
              "start_day_of_year", "end_day_of_year", "depth", "elevation", "individual_count",
              "coordinate_uncertainty_in_meters", "organism_quantity", "sample_size_value",
              "relative_organism_quantity"),
    **_fields(BOOLEAN, "has_coordinate", "has_geospatial_issue", "repatriated", "is_sequenced", "is_in_cluster"),
    **_fields(ARRAY, "recorded_by", "identified_by", suggest=True),
    **_fields(ARRAY, "recorded_by_id", "identified_by_id", "media_type", "issue", "network_key",
              "dataset_category", "measurement_type", "measurement_type_id", "dwca_extension", "checklist_key",
              "gadm_gid"),
    **_fields(VOCABULARY, "sex", "life_stage", "establishment_means", "degree_of_establishment", "pathway",
              "earliest_eon_or_lowest_eonothem", "latest_eon_or_highest_eonothem",
              "earliest_era_or_lowest_erathem", "latest_era_or_highest_erathem",
              "earliest_period_or_lowest_system", "latest_period_or_highest_system",
              "earliest_epoch_or_lowest_series", "latest_epoch_or_highest_series",
              "earliest_age_or_lowest_stage", "latest_age_or_highest_stage"),
    **_fields(VOCABULARY_ARRAY, "type_status"),
    **_fields(MILLIS, "modified", "last_interpreted"),
    **_fields(DATE, "date_identified"),
    "PUBLISHING_ORG": Field("publishingorgkey", LOWER),
    "COUNTRY": Field("countrycode", UPPER),
    "REGION": Field("region"),
    "PUBLISHED_BY_REGION": Field("publishedbyregion"),
    "RECORD_ID": Field(ID),
    "EVENT_DATE": Field("eventdate", INTERVAL),
    "EVENT_DATE_GTE": Field("eventdategte", DATE),
    "DISTANCE_FROM_CENTROID_IN_METERS": Field("distancefromcentroidinmeters", NUMBER, null_inclusive=True),
    "GEOLOGICAL_TIME": Field("geologicaltime", AGE_RANGE),
    "TAXON_KEY": Field("taxonkeys", ANCESTORS),
    "TAXONOMIC_STATUS": Field("taxonomicstatuses", STATUS),
    "TAXONOMIC_ISSUE": Field("taxonomicissue", STATUS_ARRAY),
    "IUCN_RED_LIST_CATEGORY": Field("iucnredlistcategories", STATUS),
    **{f"GADM_LEVEL_{n}_GID": Field(f"level{n}gid") for n in range(4)},
    **{rank: Field(rank.lower(), RANK) for rank in
       ("KINGDOM", "PHYLUM", "CLASS", "ORDER", "FAMILY", "GENUS", "SUBGENUS", "SPECIES", "SCIENTIFIC_NAME")},
    **{f"NUCLEOTIDE_SEQUENCE_{name.upper()}": Field("nucleotidesequence", NESTED, name.replace("_", ""), kind)
       for name, kind in (("nucleotide_sequence_id", KEYWORD), ("target_gene", KEYWORD), ("sequence", KEYWORD),
                          ("sequence_length", NUMBER), ("gc_content", NUMBER), ("non_iupac_fraction", NUMBER),
                          ("non_acgtn_fraction", NUMBER), ("n_fraction", NUMBER), ("n_runs_capped", NUMBER),
                          ("natural_language_detected", BOOLEAN), ("ends_trimmed", BOOLEAN),
                          ("gaps_or_whitespace_removed", BOOLEAN), ("invalid", BOOLEAN))},
}

# Search parameters of the event table; Humboldt ones read one element.
EVENT_FIELDS: dict[str, Field] = {
    **_fields(UPPER, "license", "publishing_country", "continent"),
    **_fields(LOWER, "dataset_key"),
    **_fields(KEYWORD, "event_type", "sample_size_unit", "type"),
    **_fields(KEYWORD, "event_id", "parent_event_id", "sampling_protocol", "locality", "state_province",
              "water_body", suggest=True),
    **_fields(NUMBER, "decimal_latitude", "decimal_longitude", "year", "month", "day", "depth", "elevation",
              "sample_size_value"),
    **_fields(ARRAY, "issue", "media_type", "network_key"),
    "COUNTRY": Field("countrycode", UPPER),
    "EVENT_DATE": Field("eventdate", INTERVAL),
    "HUMBOLDT_EVENT_DURATION_VALUE_IN_MINUTES": Field("humboldt", NESTED, "duration", NUMBER),
    "HUMBOLDT_INVENTORY_TYPES": Field("humboldt", NESTED, "inventory"),
    "HUMBOLDT_PROTOCOL_NAMES": Field("humboldt", NESTED, "protocol"),
    "HUMBOLDT_SITE_COUNT": Field("humboldt", NESTED, "sitecount", NUMBER),
}

GEOMETRY, GEO_DISTANCE = "GEOMETRY", "GEO_DISTANCE"
RANK_KEY = "_KEY"  # FAMILY_KEY, TRIBE_KEY, …: any rank of the checklist


def field_of(parameter: str, fields: dict[str, Field]) -> Field:
    name = parameter.upper()
    if name in fields:
        return fields[name]
    if fields is RECORD_FIELDS and name.endswith(RANK_KEY):
        return fields["TAXON_KEY"]
    raise ValueError(f"unknown search parameter {parameter}")


# The published snapshot's columns and types, as a DDL string.
SNAPSHOT_SCHEMA = (
    "recordid string, datasetkey string, occurrenceid string, kingdom string, phylum string, class string,"
    " `order` string, family string, genus string, species string, infraspecificepithet string,"
    " taxonrank string, scientificname string, verbatimscientificname string,"
    " verbatimscientificnameauthorship string, countrycode string, locality string, stateprovince string,"
    " occurrencestatus string, individualcount int, publishingorgkey string, decimallatitude double,"
    " decimallongitude double, coordinateuncertaintyinmeters double, coordinateprecision double,"
    " elevation double, elevationaccuracy double, depth double, depthaccuracy double, eventdate timestamp,"
    " day int, month int, year int, taxonkey string, specieskey string, basisofrecord string,"
    " institutioncode string, collectioncode string, catalognumber string, recordnumber string,"
    " identifiedby array<string>, dateidentified timestamp, license string, rightsholder string,"
    " recordedby array<string>, typestatus array<string>, establishmentmeans string,"
    " lastinterpreted timestamp, mediatype array<string>, issue array<string>"
)
