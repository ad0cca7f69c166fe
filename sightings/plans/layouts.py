"""Export layouts: an ordered term list and one value expression per term.

All layouts are plain projections: only the listed columns are read from the scan.
A term the table does not carry becomes a typed null, so a layout's columns are fixed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightings.functions import dates, text
from sightings.plans import terms as t

Pairs = Iterable[tuple[str, str]]


def _raw(df: DataFrame, term: str) -> Column:
    """The stored column, or a null of its type where the table has none."""
    return F.col(f"`{term}`") if term in df.columns else F.lit(None).cast(t.plain_type(term))


def _need_checklist(checklist: str | None) -> str:
    if not checklist:
        raise ValueError("the checklist key must not be empty")
    return checklist


def rank_value(df: DataFrame, term: str, checklist: str | None) -> Column:
    key = _need_checklist(checklist)
    if "classificationdetails" not in df.columns:
        return F.lit(None).cast("string")
    return text.nested_value(F.col("classificationdetails"), key, term)


def _common(df: DataFrame, term: str) -> Column | None:
    """Dates to text and vocabularies to concepts, as in every text layout."""
    c = _raw(df, term)
    if term in t.LOCAL_SECONDS_TERMS:
        return dates.seconds_to_local_iso8601(c)
    if term in t.UTC_SECONDS_TERMS:
        return dates.seconds_to_iso8601(c)
    if term in t.UTC_MILLIS_TERMS:
        return dates.millis_to_iso8601(c)
    if term in t.VOCABULARY_TERMS:
        return text.concept(c)
    if term in t.VOCABULARY_ARRAY_TERMS:
        return F.array_join(text.concepts(c), ";")
    return None


def tsv_value(df: DataFrame, term: str, checklist: str | None) -> Column:
    """Text layout of records: classification through the checklist, arrays joined."""
    if term == "issue":
        key = _need_checklist(checklist)
        taxonomic = text.nested_value(_raw(df, "taxonomicissue"), key) if "taxonomicissue" in df.columns else F.lit(None).cast("array<string>")
        other = _raw(df, "nontaxonomicissue") if "nontaxonomicissue" in df.columns else F.lit(None).cast("array<string>")
        return F.array_join(text.array_union_all(other, taxonomic), ";")
    if term == "taxonomicstatus":
        key = _need_checklist(checklist)
        if "taxonomicstatuses" not in df.columns:
            return F.lit(None).cast("string")
        return text.nested_value(F.col("taxonomicstatuses"), key)
    if term in t.RANK_TERMS:
        return rank_value(df, term, checklist)
    return event_value(df, term, checklist)


def event_value(df: DataFrame, term: str, checklist: str | None = None) -> Column:
    """Text layout of events: no issue and no classification handling."""
    common = _common(df, term)
    if common is not None:
        return common
    c = _raw(df, term)
    return F.array_join(c, ";") if _is_array(df, term) else c


def _is_array(df: DataFrame, term: str) -> bool:
    return term in df.columns and df.schema[term].dataType.typeName() == "array"


def avro_value(df: DataFrame, term: str, checklist: str | None = None) -> Column:
    """Dates to text, vocabularies to concepts, arrays stay arrays."""
    common = _common(df, term)
    return _raw(df, term) if common is None else common


def parquet_value(df: DataFrame, term: str, checklist: str | None = None) -> Column:
    """Dates to timestamps, vocabularies to concepts, arrays kept."""
    c = _raw(df, term)
    if term in t.LOCAL_SECONDS_TERMS + t.UTC_SECONDS_TERMS:
        return F.timestamp_seconds(c)
    if term in t.UTC_MILLIS_TERMS:
        return F.timestamp_millis(c)
    if term in t.VOCABULARY_TERMS:
        return text.concept(c)
    if term in t.VOCABULARY_ARRAY_TERMS:
        return text.concepts(c)
    return c


Value = Callable[[DataFrame, str, "str | None"], Column]


def _verbatim(df: DataFrame, term: str) -> Column:
    return _raw(df, f"v_{term}")


def project_verbatim(df: DataFrame, wanted: Iterable[str] | None = None) -> DataFrame:
    """The id and every verbatim column."""
    names = list(t.VERBATIM_TERMS if wanted is None else wanted)
    return df.select("recordid", *[_verbatim(df, n).alias(f"v_{n}") for n in names])


def project_interpreted(df: DataFrame, checklist: str, wanted: Iterable[str] | None = None) -> DataFrame:
    names = list(t.ARCHIVE_TERMS if wanted is None else wanted)
    return df.select("recordid", *[tsv_value(df, n, checklist).alias(n) for n in names])


def project_interpreted_event(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    return df.select(*[event_value(df, n).alias(n) for n in wanted])


def project_avro(df: DataFrame, wanted: Iterable[str] | None = None) -> DataFrame:
    names = list(t.SIMPLE_TERMS if wanted is None else wanted)
    return df.select("recordid", *[avro_value(df, n).alias(n) for n in names])


def parquet_verbatim_name(term: str) -> str:
    return term if term.startswith("verbatim") else f"verbatim{term}"


def project_parquet(df: DataFrame, wanted: Iterable[str] | None = None, verbatim: Iterable[str] = ()) -> DataFrame:
    names = list(t.SIMPLE_TERMS if wanted is None else wanted)
    return df.select(
        "recordid",
        *[parquet_value(df, n).alias(n) for n in names],
        *[_verbatim(df, n).alias(parquet_verbatim_name(n)) for n in verbatim],
    )


def project_taxonomic(df: DataFrame, checklist: str, ranks: Iterable[str]) -> DataFrame:
    return df.select("recordid", *[rank_value(df, r, checklist).alias(r) for r in ranks])


def project_taxonomic_list(df: DataFrame, checklist: str, column: str, keys: dict[str, str]) -> DataFrame:
    """``keys`` maps an output name to the inner map key; names joined with ``;``."""
    key = _need_checklist(checklist)
    values = [F.array_join(text.nested_value(F.col(column), key, inner), ";").alias(out) for out, inner in keys.items()]
    return df.select("recordid", *values)


def project_grouped(df: DataFrame, pairs: Pairs, checklist: str | None = None, value: Value = tsv_value) -> DataFrame:
    columns = []
    for group, term in pairs:
        if term == "recordid":
            continue
        if group == t.VERBATIM:
            columns.append(_verbatim(df, term).alias(f"v_{term}"))
        else:
            columns.append(value(df, term, checklist).alias(term))
    return df.select("recordid", *columns)


def simple_with_verbatim_pairs(verbatim: Iterable[str] | None = None) -> list[tuple[str, str]]:
    """Simple pairs, then the verbatim terms not among them, by name."""
    simple = list(t.SIMPLE_WITH_VERBATIM_TERMS)
    rest = sorted(set(t.VERBATIM_TERMS if verbatim is None else verbatim) - {n for g, n in simple if g == t.VERBATIM})
    return simple + [(t.VERBATIM, n) for n in rest]


def project_simple_with_verbatim(df: DataFrame) -> DataFrame:
    return project_grouped(df, simple_with_verbatim_pairs(), value=avro_value)


def project_map_of_life(df: DataFrame, value: Value = avro_value) -> DataFrame:
    return project_grouped(df, t.grouped(t.MAP_OF_LIFE_TERMS), value=value)


def dna_column(term: str) -> str:
    return term.replace("nucleotide_", "").replace("_", "")


def project_dna(df: DataFrame, wanted: Iterable[str] | None = None) -> DataFrame:
    """Search names to the DNA table's column names; vocabularies to concepts."""
    columns = []
    for term in t.DNA_TERMS if wanted is None else wanted:
        name = dna_column(term)
        name = "nucleotidesequenceid" if name == "sequenceid" and "sequenceid" not in df.columns else name
        c = F.col(name)
        is_struct = df.schema[name].dataType.typeName() == "struct"
        columns.append((text.concept(c) if is_struct else c).alias(name))
    return df.select("recordid", *columns)


def project_multimedia(media: DataFrame) -> DataFrame:
    return media.select("recordid", *[F.col(f"`{c}`") for c in t.MEDIA_COLUMNS])


def derive_flags(df: DataFrame) -> DataFrame:
    """Has coordinate, repatriated, distinct media types and ``|`` lists as ``;`` lists."""
    return df.select(
        "recordid",
        (F.col("decimallatitude").isNotNull() & F.col("decimallongitude").isNotNull()).alias("hascoordinate"),
        (F.col("countrycode") != F.col("publishingcountry")).alias("repatriated"),
        F.array_join(F.array_distinct(F.transform("media", lambda m: m["type"])), ";").alias("mediatype"),
        F.replace(F.array_join("recordedby", "|"), F.lit("|"), F.lit(";")).alias("recordedby"),
    )


def record_key(df: DataFrame) -> Column:
    """``dataset|occurrenceID``, or the four-part key with the unit; null if a part is missing."""
    unit = F.col("unitqualifier") if "unitqualifier" in df.columns else F.lit(None).cast("string")
    own = F.when(F.col("occurrenceid").isNotNull(), F.concat_ws("|", "datasetkey", "occurrenceid"))
    parts = ["datasetkey", "institutioncode", "collectioncode", "catalognumber"]
    complete = F.col(parts[0]).isNotNull()
    for part in parts[1:]:
        complete = complete & F.col(part).isNotNull()
    triplet = F.when(complete, F.concat_ws("|", *parts, F.coalesce(unit, F.lit("null"))))
    return F.when(F.col("datasetkey").isNotNull(), F.coalesce(own, triplet))


# Date formats printed in a layout's description.
DATE_FORMATS = {
    "local_seconds": "yyyy-MM-ddTHH:mm:ss",
    "utc_seconds": "yyyy-MM-ddTHH:mm:ssZ",
    "utc_millis": "yyyy-MM-ddTHH:mm:ss.SSSZ",
}


def _described(term: str) -> tuple[str, str | None, str | None]:
    """(type, date format, list delimiter) of a term."""
    if term in t.LOCAL_SECONDS_TERMS:
        return "DATE", DATE_FORMATS["local_seconds"], None
    if term in t.UTC_SECONDS_TERMS:
        return "DATE", DATE_FORMATS["utc_seconds"], None
    if term in t.UTC_MILLIS_TERMS:
        return "DATE", DATE_FORMATS["utc_millis"], None
    kind = t.plain_type(term).upper()
    return kind, None, ";" if kind.startswith("ARRAY") else None


def describe_layout(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Name, type, date format and delimiter of each column, and whether it has gaps.

    One aggregation over the table counts the values of every column.
    """
    names = ["recordid", *wanted]
    counted = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{n}`")).alias(n) for n in names])
    rows = []
    for n in names:
        kind, form, delimiter = _described(n)
        rows.append(F.struct(
            F.lit(n).alias("name"), F.lit(kind).alias("type"), F.lit(form).cast("string").alias("typeformat"),
            F.lit(delimiter).cast("string").alias("delimiter"), (F.col(f"`{n}`") < F.col("_rows")).alias("nullable")))
    return counted.select(F.explode(F.array(*rows)).alias("c")).select("c.*")
