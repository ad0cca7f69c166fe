"""Full-text search, suggestions and term search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightings import model as m
from sightings.operators.facets import facet, facet_terms

# How much a hit in the classification or the verbatim names adds.
BOOSTS = {"classification": 90, "scientific_name": 100, "verbatim_name": 100}

# Verbatim terms left out of the full-text field.
NOT_FULL_TEXT = {
    "verbatimeventdate", "verbatimcoordinates", "verbatimcoordinatesystem", "verbatimdepth", "verbatimelevation",
    "verbatimlatitude", "verbatimlongitude", "eventtime", "taxonid", "recordid", "datasetkey",
}


def full_text(df: DataFrame) -> Column:
    """The record's texts as a set: plain text columns, vocabulary concepts, decimal numbers, verbatim texts, year, month and day.

    Booleans, whole numbers, dates, keys, arrays, maps and extensions are left out.  Keys are
    whole numbers or UUIDs where these texts are collected from typed values, and extensions are
    maps; here they are texts, so they go by name.
    """
    values = []
    for field in df.schema:
        name, kind = field.name.lower(), field.dataType.typeName()
        verbatim = name.removeprefix("v_")
        if verbatim == name and (name.endswith("key") or name.startswith("ext_")):
            continue
        if kind == "string" and name not in NOT_FULL_TEXT and verbatim not in NOT_FULL_TEXT and name != "eventdate":
            values.append(F.col(f"`{field.name}`"))
        elif kind == "struct" and "concept" in field.dataType.names:
            values.append(F.col(f"`{field.name}`.concept"))
        elif kind == "double":
            values.append(F.col(f"`{field.name}`").cast("string"))
        elif name in ("year", "month", "day"):
            values.append(F.col(f"`{field.name}`").cast("string"))
    return F.array_distinct(F.array_compact(F.array(*values)))


def tokens(c: Column) -> Column:
    """Lower-case words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def search(df: DataFrame, query: str, text: Column, boosted: Sequence[tuple[Column, int]] = ()) -> DataFrame:
    """Rows with any word of the query, scored by matched words and boosted columns."""
    words = tokens_of(query)
    if not words:
        return df.withColumn("score", F.lit(0)).limit(0)
    wanted = F.array(*map(F.lit, words))

    def hits(c: Column) -> Column:
        return F.size(F.array_intersect(tokens(c), wanted))

    score = hits(text)
    for c, boost in boosted:
        score = score + F.coalesce(hits(c), F.lit(0)) * boost
    matching = df.filter(F.arrays_overlap(tokens(text), wanted))
    return matching.withColumn("score", score)


def tokens_of(query: str) -> list[str]:
    words: list[str] = []
    for word in "".join(ch.lower() if ch.isalnum() else " " for ch in query).split():
        if word not in words:
            words.append(word)
    return words


def suggest(df: DataFrame, parameter: str, prefix: str, limit: int = 10, fields: dict[str, m.Field] | None = None) -> DataFrame:
    """Distinct values of a suggestible field that start with the prefix, in order."""
    fields = m.RECORD_FIELDS if fields is None else fields
    if not m.field_of(parameter, fields).suggest:
        raise ValueError(f"{parameter} has no suggestions")
    values = df.select(F.explode(facet_terms(parameter, fields)).alias("value"))
    return values.filter(F.lower("value").startswith(prefix.lower())).distinct().orderBy("value").limit(limit)


def field_terms(df: DataFrame, parameter: str, query: str, limit: int = 10, fields: dict[str, m.Field] | None = None) -> DataFrame:
    """Most frequent terms of the records whose field starts with the query or holds it.

    One word matches as a whole word; several words match as a phrase.
    """
    fields = m.RECORD_FIELDS if fields is None else fields
    words = tokens_of(query)
    terms = facet_terms(parameter, fields)

    def matches(x: Column) -> Column:
        spaced = F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " "), F.lit(" "))
        if " " in query.strip():
            found = spaced.contains(" " + " ".join(words) + " ")
        else:
            found = F.lit(False)
            for word in words:
                found = found | spaced.contains(f" {word} ")
        return F.lower(x).startswith(query.lower()) | found

    return facet(df.filter(F.exists(terms, matches)), parameter, fields, limit=limit)


def searchable_terms(fields: dict[str, m.Field] | None = None) -> list[tuple[str, str]]:
    """(search parameter, kind) of every searchable term."""
    return sorted((name, field.kind) for name, field in (m.RECORD_FIELDS if fields is None else fields).items())
