"""Scientific-name parameter: exact names of a backbone to taxon keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightings.operators.predicates import IN_LIST_LIMIT


def name_keys(backbone: DataFrame, names: list[str]) -> DataFrame:
    """Keys of the names, the accepted one where the usage is a synonym."""
    wanted = [n.lower() for n in names]
    return (backbone.filter(F.lower("scientificname").isin(wanted))
            .select(F.coalesce("acceptedkey", "usagekey").alias("key")).distinct())


def match_names(df: DataFrame, backbone: DataFrame, names: list[str], checklist: str) -> DataFrame:
    """Records with one of the keys among their ancestors; no known name gives no record.

    A request names a few taxa, so the keys normally fit a literal list; whether they do
    is checked, and a longer key table is joined with the exploded ancestors instead.
    """
    keys = name_keys(backbone, names)
    ancestors = F.try_element_at("taxonkeys", F.lit(checklist))
    few = [row.key for row in keys.limit(IN_LIST_LIMIT + 1).collect()]
    if not few:
        return df.limit(0)
    if len(few) <= IN_LIST_LIMIT:
        return df.filter(F.exists(ancestors, lambda x: x.isin(few)))
    found = df.select("recordid", F.explode(ancestors).alias("key")).join(keys, "key", "left_semi")
    return df.join(found.select("recordid"), "recordid", "left_semi")
