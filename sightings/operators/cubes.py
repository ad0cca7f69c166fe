"""Data cubes: dimensions, measures and higher-taxon totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def data_cube(df: DataFrame, dimensions: Mapping[str, Column], measures: Mapping[str, Column]) -> DataFrame:
    """Grouped counts under the given names; combined map-side before the shuffle."""
    groups = [c.alias(name) for name, c in dimensions.items()]
    return df.groupBy(*groups).agg(F.count("*").alias("occurrences"), *[c.alias(n) for n, c in measures.items()])


def with_key_total(cube: DataFrame, df: DataFrame, key: str, out: str) -> DataFrame:
    """Adds the records of the cell's higher taxon; null where the key is null.

    Equals a sum of the cells over the whole partition of the key.  The total comes from
    its own map-side combined count and a join, because a window would sort all cells of
    one key in a single task.
    """
    totals = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(out))
    return cube.join(totals, key, "left")


def cube_table(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Counts for every subset of the dimensions, ready for address look-ups.

    The rows are first counted on all dimensions, so the 2**n fold expansion starts
    from cells, not from records.
    """
    cells = df.groupBy(*dimensions).agg(F.count("*").alias("n"))
    return cells.cube(*dimensions).agg(F.sum("n").alias("count"), F.grouping_id().alias("grouping"))


def address_count(cube: DataFrame, dimensions: Sequence[str], address: Mapping[str, str]) -> DataFrame:
    """The count at ``dimension = value`` for some dimensions and any value of the others."""
    unknown = set(address) - set(dimensions)
    if unknown:
        raise ValueError(f"not a dimension of the cube: {sorted(unknown)}")
    grouping = 0
    for dimension in dimensions:
        grouping = grouping * 2 + (0 if dimension in address else 1)
    found = cube.filter(F.col("grouping") == grouping)
    for dimension, value in address.items():
        found = found.filter(F.col(dimension) == value)
    return found.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
