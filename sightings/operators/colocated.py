"""Tables that share buckets: joins on the bucket key without a shuffle of either side.

The main table and its extensions are written in buckets of the record id (or of dataset and event), each sorted by
it.  A join reads bucket by bucket and merges.  Added rows make a second file in a bucket, which Spark has to sort
again; compaction writes one sorted file a bucket as the table's next version.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sightings.sources.versions import VersionLog


# Rows of the main table in one bucket, about.
BUCKET_ROWS = 250_000


def buckets_for(rows: int, least: int = 8) -> int:
    """More buckets for more rows: a task reads and sorts one of them."""
    return max(least, math.ceil(rows / BUCKET_ROWS))


class BucketedTables:
    """Tables of one folder with the same number of buckets; a table's key and folder stand in its version log."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._open: dict[tuple[str, int], str] = {}

    def _log(self, name: str) -> VersionLog:
        return VersionLog(self.spark, f"{self.folder}/{name}-log")

    def _write(self, df: DataFrame, table: str, path: str, keys: Sequence[str], mode: str) -> None:
        dealt = df.repartition(self.buckets, *keys)  # a task a bucket, so a file a bucket
        writer = dealt.write.bucketBy(self.buckets, *keys).sortBy(*keys).format("parquet").mode(mode)
        writer.option("path", path).saveAsTable(table)

    def write(self, name: str, df: DataFrame, keys: Sequence[str]) -> None:
        """The table's next version."""
        log = self._log(name)
        current = log.current()
        path, table = f"{self.folder}/{name}-{uuid.uuid4().hex}", f"{name}_{uuid.uuid4().hex}"
        self._write(df, table, path, keys, "overwrite")
        made = log.commit({"path": path, "keys": list(keys), "buckets": self.buckets, "schema": df.schema.jsonValue()}, current.number if current else None)
        self._open[(name, made.number)] = table

    def table(self, name: str) -> DataFrame:
        """The last version, with its buckets known to the planner."""
        current = self._log(name).current()
        if current is None:
            raise LookupError(f"{name} has no version yet")
        key = (name, current.number)
        if key not in self._open:
            entry, table = current.entry, f"{name}_{uuid.uuid4().hex}"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(entry["schema"]))
            by = ", ".join(f"`{k}`" for k in entry["keys"])
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet LOCATION '{entry['path']}' CLUSTERED BY ({by}) SORTED BY ({by}) INTO {entry['buckets']} BUCKETS")
            self._open[key] = table
        return self.spark.table(self._open[key])

    def append(self, name: str, df: DataFrame) -> None:
        self.table(name)
        current = self._log(name).current()
        self._write(df.select(*self.table(name).columns), self._open[(name, current.number)], current.entry["path"], current.entry["keys"], "append")

    def compact(self, name: str) -> None:
        """One sorted file a bucket; readers of the former version keep it."""
        entry = self._log(name).current().entry
        # the files are read as such: of a bucketed table the planner would take the rows for dealt out already
        self.write(name, self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(entry["path"]), entry["keys"])

    def join(self, left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
        """A merge of the buckets of both sides; each may be filtered before."""
        return left.join(right.hint("merge"), list(keys), how)
