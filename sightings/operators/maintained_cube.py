"""A count cube that is kept up by changes: signed cells of old and new record versions, merged when read.

The cube of a batch has -1 for every record version that went and +1 for every one that came, summed over all subsets
of the dimensions; only cells that change are written.  A batch is a folder and an entry of the version log that
names it, so it counts once however often it is repeated, and a batch that failed half way doesn't count.  A count
reads one grouping's folders only.  ``compact`` sums all folders to one.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightings.sources.versions import VersionLog


class MaintainedCube:
    """The cube of some dimensions at a path."""

    def __init__(self, spark: SparkSession, path: str, dimensions: Sequence[str]):
        self.spark, self.path, self.dimensions = spark, path.rstrip("/"), list(dimensions)
        self.log = VersionLog(spark, f"{self.path}/log")

    def _entry(self) -> tuple[int | None, dict]:
        current = self.log.current()
        return (current.number, current.entry) if current else (None, {"folders": [], "batches": [], "schema": None})

    def _signed(self, old: DataFrame | None, new: DataFrame | None) -> DataFrame:
        parts = [df.select(*self.dimensions).groupBy(*self.dimensions).agg((F.count("*") * sign).alias("n")) for df, sign in ((old, -1), (new, 1)) if df is not None]
        cells = reduce(DataFrame.unionByName, parts).groupBy(*self.dimensions).agg(F.sum("n").alias("n")).where("n <> 0")
        return cells.cube(*self.dimensions).agg(F.sum("n").alias("count"), F.grouping_id().alias("grouping")).where("count <> 0")

    def _write(self, cells: DataFrame) -> str:
        folder = f"{self.path}/cells-{uuid.uuid4().hex}"
        cells.repartition("grouping", *self.dimensions).sortWithinPartitions("grouping", *self.dimensions).write.partitionBy("grouping").parquet(folder)
        return folder

    def apply(self, batch: str, old: DataFrame | None = None, new: DataFrame | None = None) -> bool:
        """Takes in a batch of record versions that went and that came; False if the batch was taken in before."""
        number, entry = self._entry()
        if batch in entry["batches"]:
            return False
        if old is None and new is None:
            return True
        cells = self._signed(old, new)
        folder = self._write(cells)
        schema = entry["schema"] or cells.schema.jsonValue()
        self.log.commit({"folders": [*entry["folders"], folder], "batches": [*entry["batches"], batch], "schema": schema}, number)
        return True

    def cells(self, groupings: Sequence[int] | None = None) -> DataFrame:
        """The cube as ``cubes.cube_table`` makes it: dimensions, count, grouping; of some groupings if these are given."""
        _, entry = self._entry()
        if not entry["folders"]:
            raise LookupError("the cube has no batch yet")
        schema = StructType.fromJson(entry["schema"])
        parts = [self.spark.read.schema(schema).parquet(f) for f in entry["folders"]]
        if groupings is not None:
            parts = [p.where(F.col("grouping").isin(list(groupings))) for p in parts]
        rows = reduce(DataFrame.unionByName, parts)
        return rows.groupBy("grouping", *self.dimensions).agg(F.sum("count").alias("count")).where("count <> 0")

    def compact(self) -> None:
        """One folder in place of all; the batches stay known."""
        number, entry = self._entry()
        if len(entry["folders"]) > 1:
            folder = self._write(self.cells())
            self.log.commit({**entry, "folders": [folder]}, number)

    def _grouping(self, known: Sequence[str]) -> int:
        unknown = set(known) - set(self.dimensions)
        if unknown:
            raise ValueError(f"not a dimension of the cube: {sorted(unknown)}")
        return int("".join("0" if d in known else "1" for d in self.dimensions), 2)

    def count(self, address: Mapping[str, object]) -> DataFrame:
        """The count at ``dimension = value`` for some dimensions and any value of the others."""
        return self.counts(address, []).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))

    def counts(self, address: Mapping[str, object], by: Sequence[str]) -> DataFrame:
        """Counts by further dimensions at an address."""
        found = self.cells([self._grouping([*address, *by])])
        for dimension, value in address.items():
            found = found.where(F.col(dimension) == value)
        return found.select(*by, "count")
