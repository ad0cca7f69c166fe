"""Species lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def species_list(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct taxon rows with their number of records; a row without a taxon counts 0."""
    return df.groupBy(*columns).agg(F.count("taxonkey").alias("numberofoccurrences"))


def species_list_by_key(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per taxon key, with the attributes of the record with the smallest id."""
    attributes = [c for c in columns if c != "taxonkey"]
    firsts = F.min_by(F.struct(*attributes), F.col("recordid")).alias("first")
    grouped = df.filter("taxonkey IS NOT NULL").groupBy("taxonkey").agg(firsts, F.count("*").alias("numberofoccurrences"))
    return grouped.select("taxonkey", "first.*", "numberofoccurrences")
