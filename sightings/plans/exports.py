"""Export jobs: filter, project, write, and summarise what was written."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightings.functions.text import fasta
from sightings.operators import agents, citations, species
from sightings.operators.events import records_of
from sightings.operators.metrics import count_where
from sightings.plans import layouts, terms
from sightings.session import staged
from sightings.sources import sinks


# ---- rows that go with the exported records -----------------------------------------------

def extension_rows(extension: DataFrame, exported: DataFrame) -> DataFrame:
    """Extension rows of exported records.

    Record ids are unique, so a semi join equals the inner join and ships ids only.
    """
    return extension.join(exported.select("recordid"), "recordid", "left_semi")


def media_rows(media: DataFrame, exported: DataFrame) -> DataFrame:
    return extension_rows(media, exported)


def sequence_rows(dna: DataFrame, exported: DataFrame) -> DataFrame:
    return extension_rows(dna.filter("sequence IS NOT NULL"), exported)


def with_humboldt(events: DataFrame, humboldt: DataFrame, key: str) -> DataFrame:
    """Events with their inventory rows; an event with several appears several times.

    A left join cannot split a hot key of its right side.  An inner join can, so the
    events without an inventory are added by an anti join on the distinct keys.
    """
    rows = humboldt.withColumnRenamed("recordid", key)
    without = events.join(rows.select(key).distinct(), key, "left_anti")
    return events.join(rows, key).unionByName(without, allowMissingColumns=True)


# ---- jobs ------------------------------------------------------------------------------------

Tables = dict[str, DataFrame]


def _with_citation(result: DataFrame, exported: DataFrame, with_license: bool = True) -> Tables:
    return {"result": result, "citation": citations.citation(exported, with_license), "count": count_where(exported)}


def simple_text(records: DataFrame, where: Column, checklist: str) -> Tables:
    exported = records.filter(where)
    pairs = [(terms.INTERPRETED, name) for name in terms.SIMPLE_TERMS]
    return _with_citation(layouts.project_grouped(exported, pairs, checklist), exported)


def simple_avro(records: DataFrame, where: Column) -> Tables:
    exported = records.filter(where)
    return _with_citation(layouts.project_avro(exported), exported)


def simple_with_verbatim_avro(records: DataFrame, where: Column) -> Tables:
    exported = records.filter(where)
    return _with_citation(layouts.project_simple_with_verbatim(exported), exported)


def simple_parquet(records: DataFrame, where: Column) -> Tables:
    exported = records.filter(where)
    return _with_citation(layouts.project_parquet(exported), exported)


def map_of_life(records: DataFrame, where: Column) -> Tables:
    exported = records.filter(where)
    return _with_citation(layouts.project_map_of_life(exported), exported)


def species_export(records: DataFrame, where: Column, columns: list[str]) -> Tables:
    exported = records.filter(where)
    listed = species.species_list(exported, columns)
    return {"result": listed, "citation": citations.citation(exported), "count": count_where(listed)}


def person_export(records: DataFrame, where: Column) -> Tables:
    """Person-centred rows with the agent, family and identifier tables of the same rows.

    The filtered rows are staged once in the shared folder: four tables read them.
    """
    rows = staged(agents.person_rows(records.filter(where)), "persons")
    return {
        "result": rows,
        "citation": citations.citation(rows),
        "agents": agents.agents(rows),
        "families": agents.families(rows),
        "identifiers": agents.identifiers(rows),
    }


def full_archive(records: DataFrame, where: Column, checklist: str, media: DataFrame, dna: DataFrame | None = None,
                 extensions: Mapping[str, DataFrame] | None = None) -> Tables:
    """Verbatim and interpreted tables, media, DNA, extensions and the citation.

    The base table is scanned once: the filtered rows are staged in the shared folder,
    and every output reads its columns from there.
    """
    exported = staged(records.filter(where), "archive", codec="zstd")
    out = {
        "verbatim": layouts.project_verbatim(exported),
        "occurrence": layouts.project_interpreted(exported, checklist),
        "multimedia": layouts.project_multimedia(media_rows(media, exported)),
        "citation": citations.citation(exported, with_license=False),
    }
    if dna is not None:
        out["dna"] = layouts.project_dna(extension_rows(dna, exported))
    for name, extension in (extensions or {}).items():
        out[f"verbatim_{name}"] = extension_rows(extension, exported)
    return out


def event_archive(events: DataFrame, where: Column, humboldt: DataFrame, records: DataFrame, wanted: list[str]) -> Tables:
    """Events with their inventories and the records of the exported events."""
    exported = staged(events.filter(where), "event-archive")
    return {
        "event": layouts.project_interpreted_event(exported, wanted),
        "humboldt": extension_rows(humboldt, exported.select(F.col("eventid").alias("recordid"))),
        "occurrence": records_of(exported, records),
        "citation": citations.citation(exported, with_license=False),
    }


def fasta_archive(records: DataFrame, where: Column, dna: DataFrame) -> Tables:
    """Records that have a sequence, the sequences as text, and the citation."""
    with_sequence = dna.filter("sequence IS NOT NULL").select("recordid").distinct()
    exported = staged(records.filter(where).join(with_sequence, "recordid", "left_semi"), "fasta")
    rows = sequence_rows(dna, exported)
    text = fasta(F.col("nucleotidesequenceid"), F.col("recordid"), F.col("targetgene.concept"), F.col("sequence"))
    return {
        "occurrence": exported,
        "fasta": rows.select(text.alias("fasta")),
        "sequences": layouts.project_dna(rows),
        "citation": citations.citation(exported, with_license=False),
    }


def verbatim_extensions(extensions: Mapping[str, DataFrame], exported: DataFrame) -> Tables:
    """Each requested extension cut to the exported records; the ids are staged once."""
    ids = staged(exported.select("recordid"), "ids")
    return {name: extension_rows(extension, ids) for name, extension in extensions.items()}


def write_export(tables: Tables, path: str, fmt: str = "parquet") -> DataFrame:
    return sinks.write_bundle(tables, path, fmt)


def _differences(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Number of keys whose amounts differ between two (keys, n) frames.

    The sides are added up with opposite signs: one map-side combined aggregation, no join.
    """
    signed = left.select(*keys, "n").unionByName(right.select(*keys, (-F.col("n")).alias("n")))
    return signed.groupBy(*keys).agg(F.sum("n").alias("n")).agg(F.count(F.when(F.col("n") != 0, 1)).alias("broken"))


def consistency_report(verbatim: DataFrame, interpreted: DataFrame, citation: DataFrame) -> DataFrame:
    """One row per check of an archive: what was checked, and whether it holds."""
    one = F.lit(1).alias("n")
    counted = citations.citation(interpreted, with_license=False).withColumnRenamed("num_occurrences", "n")
    cited = citation.groupBy("datasetkey").agg(F.sum("num_occurrences").alias("n"))
    everything = F.lit("all").alias("all")
    checks = [
        ("same records verbatim and interpreted", _differences(verbatim.select("recordid", one), interpreted.select("recordid", one), "recordid")),
        ("citation counts per dataset", _differences(cited, counted, "datasetkey")),
        ("citation total", _differences(cited.select(everything, "n"), counted.select(everything, "n"), "all")),
    ]
    frames = [df.select(F.lit(name).alias("check"), (F.col("broken") == 0).alias("holds")) for name, df in checks]
    return reduce(DataFrame.unionByName, frames)


def column_count_report(lines: DataFrame, columns: int) -> DataFrame:
    """Lines of a written text export with another number of columns than the header."""
    wrong = F.size(F.split("value", "\t", -1)) != columns
    return lines.agg(F.count(F.when(wrong, 1)).alias("broken")).select(
        F.lit("equal column count per line").alias("check"), (F.col("broken") == 0).alias("holds"))
