"""Export terms: how each is stored, and the fixed term lists of the layouts."""

from __future__ import annotations

VERBATIM, INTERPRETED = "verbatim", "interpreted"

# Terms by the way they are stored; anything else is a plain column.
RANK_TERMS = (
    "kingdom phylum class order family genus subgenus species infraspecificepithet specificepithet genericname"
    " scientificname scientificnameauthorship taxonrank taxonkey acceptedtaxonkey acceptedscientificname"
    " kingdomkey phylumkey classkey orderkey familykey genuskey subgenuskey specieskey"
).split()
LOCAL_SECONDS_TERMS = "eventdategte eventdatelte dateidentified".split()
UTC_SECONDS_TERMS = "crawled".split()
UTC_MILLIS_TERMS = "modified lastinterpreted lastparsed lastcrawled".split()
VOCABULARY_TERMS = "sex lifestage establishmentmeans degreeofestablishment pathway eventtype".split()
VOCABULARY_ARRAY_TERMS = ["typestatus"]
ARRAY_TERMS = (
    "recordedby identifiedby recordedbyid identifiedbyid mediatype datasetid datasetname othercatalognumbers"
    " preparations samplingprotocol higherGeography georeferencedby networkkey"
).lower().split()
INT_TERMS = "year month day individualcount startdayofyear enddayofyear".split()
DOUBLE_TERMS = (
    "decimallatitude decimallongitude coordinateuncertaintyinmeters coordinateprecision elevation elevationaccuracy"
    " depth depthaccuracy distancefromcentroidinmeters organismquantity samplesizevalue"
).split()
BOOLEAN_TERMS = "hascoordinate hasgeospatialissues repatriated issequenced isincluster".split()

# The simple export, the published snapshot's order.
SIMPLE_TERMS = (
    "datasetkey occurrenceid kingdom phylum class order family genus species infraspecificepithet taxonrank"
    " scientificname verbatimscientificname verbatimscientificnameauthorship countrycode locality stateprovince"
    " occurrencestatus individualcount publishingorgkey decimallatitude decimallongitude"
    " coordinateuncertaintyinmeters coordinateprecision elevation elevationaccuracy depth depthaccuracy eventdate"
    " day month year taxonkey specieskey basisofrecord institutioncode collectioncode catalognumber recordnumber"
    " identifiedby dateidentified license rightsholder recordedby typestatus establishmentmeans lastinterpreted"
    " mediatype issue"
).split()

# The interpreted terms of a full archive this engine's tables carry.
ARCHIVE_TERMS = SIMPLE_TERMS + (
    "publishingcountry eventid eventtime sex lifestage taxonomicstatus recordedbyid identifiedbyid modified"
    " eventdategte eventdatelte hascoordinate distancefromcentroidinmeters"
).split()

# The verbatim terms carried beside them.
VERBATIM_TERMS = (
    "scientificname locality country countrycode basisofrecord decimallatitude decimallongitude geodeticdatum"
    " coordinateuncertaintyinmeters coordinateprecision minimumdepthinmeters maximumdepthinmeters year month day"
    " eventdate startdayofyear enddayofyear recordedby identifiedby recordedbyid identifiedbyid"
).split()

# The 76 terms of the species-range export ("v:" marks verbatim).
MAP_OF_LIFE_TERMS = (
    "recordid publishingorgkey datasetkey occurrenceid"
    " taxonomicstatus kingdom phylum class order family genus subgenus species specificepithet infraspecificepithet"
    " taxonrank scientificname acceptedscientificname v:verbatimtaxonrank v:scientificname"
    " v:scientificnameauthorship v:vernacularname"
    " taxonkey acceptedtaxonkey specieskey"
    " countrycode locality stateprovince habitat locationremarks"
    " occurrencestatus individualcount"
    " hascoordinate decimallatitude decimallongitude coordinateuncertaintyinmeters coordinateprecision elevation"
    " elevationaccuracy depth depthaccuracy hasgeospatialissues v:verbatimcoordinatesystem v:verbatimelevation"
    " v:verbatimdepth v:verbatimlocality v:verbatimsrs"
    " eventdategte eventtime day month year fieldnotes eventremarks v:verbatimeventdate"
    " basisofrecord institutioncode collectioncode catalognumber recordnumber"
    " identifiedby identifiedbyid dateidentified identificationremarks"
    " license rightsholder recordedby typestatus establishmentmeans"
    " samplesizeunit samplesizevalue samplingeffort samplingprotocol"
    " lastinterpreted mediatype issue"
).split()

# Simple terms plus the verbatim ones of the simple-with-verbatim export.
SIMPLE_WITH_VERBATIM_TERMS = [(INTERPRETED, t) for t in SIMPLE_TERMS] + [
    (VERBATIM, t) for t in ("scientificname", "locality", "eventdate")]

# Media columns, in order; "created" is kept as it came.
MEDIA_COLUMNS = (
    "type format identifier references title description source audience created creator contributor publisher"
    " license rightsHolder"
).split()

# Terms of the DNA table.
DNA_TERMS = "nucleotide_sequence_id nucleotide_sequence nucleotide_sequence_length nucleotide_target_gene".split()

# Taxon columns of a species list.
SPECIES_TERMS = (
    "taxonkey scientificname acceptedtaxonkey acceptedscientificname taxonrank taxonomicstatus kingdom kingdomkey"
    " phylum phylumkey class classkey order orderkey family familykey genus genuskey species specieskey"
    " iucnredlistcategory"
).split()


def grouped(terms: list[str]) -> list[tuple[str, str]]:
    """``v:term`` notation to (group, term) pairs."""
    return [(VERBATIM, t[2:]) if t.startswith("v:") else (INTERPRETED, t) for t in terms]


def plain_type(term: str) -> str:
    if term in INT_TERMS:
        return "int"
    if term in DOUBLE_TERMS:
        return "double"
    if term in BOOLEAN_TERMS:
        return "boolean"
    if term in ARRAY_TERMS or term == "issue":
        return "array<string>"
    if term in LOCAL_SECONDS_TERMS + UTC_SECONDS_TERMS + UTC_MILLIS_TERMS:
        return "bigint"
    if term in VOCABULARY_TERMS:
        return "struct<concept:string,lineage:array<string>>"
    if term in VOCABULARY_ARRAY_TERMS:
        return "struct<concepts:array<string>,lineage:array<string>>"
    return "string"
