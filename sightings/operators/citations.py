"""Citation and licence summaries of an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licences from the most open to the most restrictive.
LICENCES = ("CC0_1_0", "CC_BY_4_0", "CC_BY_NC_4_0")


def citation(df: DataFrame, with_license: bool = True) -> DataFrame:
    keys = ["datasetkey", "license"] if with_license else ["datasetkey"]
    return df.filter("datasetkey IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("num_occurrences"))


def license_rank(c: Column) -> Column:
    """Place in the order of restrictiveness; null for unknown licences, which are ignored."""
    return F.array_position(F.array(*map(F.lit, LICENCES)), c)


def most_restrictive(df: DataFrame, *keys: str, default: str = LICENCES[0]) -> DataFrame:
    if default not in LICENCES:
        raise ValueError("the default must be a concrete licence")
    rank = F.greatest(F.max(F.when(license_rank(F.col("license")) > 0, license_rank(F.col("license")))),
                      F.lit(LICENCES.index(default) + 1))
    names = F.array(*map(F.lit, LICENCES))
    return df.groupBy(*keys).agg(F.element_at(names, rank.cast("int")).alias("license"))


def dataset_usage(citations: DataFrame) -> DataFrame:
    """Total per dataset of several (partial) citation tables."""
    return citations.groupBy("datasetkey").agg(F.sum("num_occurrences").alias("num_occurrences"))


def merge_partials(partials: list[DataFrame]) -> DataFrame:
    """Union of partial results of workers, added up."""
    merged = partials[0]
    for partial in partials[1:]:
        merged = merged.unionByName(partial)
    return dataset_usage(merged)
