"""A sorted and counted dictionary of the terms of a table's fields: suggestions and term search without the table.

A term has an entry under itself and one under what follows each of its words' starts, both in lower case; "starts
with" and "has the word" are prefixes of an entry then, and prefixes are ranges of a sorted column, which the scan prunes.
Records that come or go give signed counts, which are appended and summed when read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings import model as m
from sightings.operators.facets import facet_terms
from sightings.operators.text_search import tokens_of
from sightings.sources.versions import VersionLog

_SCHEMA = "term string, entry string, count bigint, field string, kind string"
WHOLE, WORD = "whole", "word"


def term_counts(df: DataFrame, parameters: Sequence[str], fields: dict[str, m.Field], sign: int = 1) -> DataFrame:
    """(field, term, count): records with each term of each field."""
    parts = [df.select(F.lit(p).alias("field"), F.explode(F.array_distinct(facet_terms(p, fields))).alias("term")) for p in parameters]
    return reduce(DataFrame.unionByName, parts).groupBy("field", "term").agg((F.count("*") * sign).alias("count"))


def _entries(counted: DataFrame) -> DataFrame:
    """The entries of counted terms: the term itself, and its words from each one on, with a space behind each."""
    words = F.filter(F.split(F.lower("term"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    tails = F.transform(words, lambda _, i: F.concat(F.array_join(F.slice("words", i + 1, F.size("words")), " "), F.lit(" ")))
    whole = counted.select("term", F.lower("term").alias("entry"), "count", "field", F.lit(WHOLE).alias("kind"))
    of_words = counted.withColumn("words", words).select("term", F.explode(F.array_distinct(tails)).alias("entry"), "count", "field", F.lit(WORD).alias("kind"))
    return whole.unionByName(of_words)


class TermDictionary:
    """The dictionary of some search parameters at a path."""

    def __init__(self, spark: SparkSession, path: str, fields: dict[str, m.Field] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.fields = m.RECORD_FIELDS if fields is None else fields
        self.log = VersionLog(spark, f"{self.path}/log")

    def _entry(self) -> tuple[int | None, dict]:
        current = self.log.current()
        return (current.number, current.entry) if current else (None, {"folders": [], "batches": []})

    def _write(self, entries: DataFrame) -> str:
        folder = f"{self.path}/terms-{uuid.uuid4().hex}"
        ranged = entries.repartitionByRange("field", "kind", "entry").sortWithinPartitions("field", "kind", "entry")
        ranged.write.partitionBy("field", "kind").parquet(folder)
        return folder

    def apply(self, batch: str, parameters: Sequence[str], old: DataFrame | None = None, new: DataFrame | None = None) -> bool:
        """Takes in records that went and that came; False if the batch was taken in before."""
        number, entry = self._entry()
        if batch in entry["batches"]:
            return False
        parts = [term_counts(df, parameters, self.fields, sign) for df, sign in ((old, -1), (new, 1)) if df is not None]
        counted = reduce(DataFrame.unionByName, parts).groupBy("field", "term").agg(F.sum("count").alias("count")).where("count <> 0")
        folder = self._write(_entries(counted))
        self.log.commit({"folders": [*entry["folders"], folder], "batches": [*entry["batches"], batch]}, number)
        return True

    def compact(self) -> None:
        number, entry = self._entry()
        if len(entry["folders"]) > 1:
            folder = self._write(self.entries().groupBy("term", "entry", "field", "kind").agg(F.sum("count").alias("count")).where("count <> 0"))
            self.log.commit({**entry, "folders": [folder]}, number)

    def entries(self) -> DataFrame:
        _, entry = self._entry()
        if not entry["folders"]:
            return self.spark.createDataFrame([], _SCHEMA)
        return reduce(DataFrame.unionByName, [self.spark.read.schema(_SCHEMA).parquet(f) for f in entry["folders"]])

    def _terms(self, parameter: str, kind: str, prefix: str) -> DataFrame:
        rows = self.entries().where((F.col("field") == parameter) & (F.col("kind") == kind) & F.col("entry").startswith(prefix))
        by_entry = rows.groupBy("term", "entry").agg(F.sum("count").alias("count"))  # a term may have several such entries
        return by_entry.groupBy("term").agg(F.max("count").alias("count")).where("count > 0")

    def suggest(self, parameter: str, prefix: str, limit: int = 10) -> DataFrame:
        """Terms of a field that start with the prefix, in order."""
        if not m.field_of(parameter, self.fields).suggest:
            raise ValueError(f"{parameter} has no suggestions")
        return self._terms(parameter, WHOLE, prefix.lower()).select(F.col("term").alias("value")).orderBy("value").limit(limit)

    def field_terms(self, parameter: str, query: str, limit: int = 10) -> DataFrame:
        """Most frequent terms that start with the query or hold it: one word as a whole word, several as a phrase.

        For fields of one term a record: of others the records' further terms would count too.
        """
        if m.field_of(parameter, self.fields).kind not in (m.KEYWORD, m.UPPER, m.LOWER):
            raise ValueError(f"{parameter} may have several terms in a record")
        words = tokens_of(query)
        held = [" ".join(words)] if " " in query.strip() else words
        found = self._terms(parameter, WHOLE, query.lower())
        for phrase in held:
            found = found.unionByName(self._terms(parameter, WORD, f"{phrase} "))
        return found.distinct().orderBy(F.desc("count"), "term").limit(limit)
