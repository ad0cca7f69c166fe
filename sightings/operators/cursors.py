"""Pages at any depth: a sorted copy whose rows carry their place, and cursors that go on after a row.

The copy is written once per result or table version.  A page is a range of places: the list of the copy's files and
the statistics inside them leave one or two row groups to read, however deep the page lies.  A cursor is the sort key
of the last row seen; the page after it is found in the same copy or, as a top-k of the rows behind it, in any table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.operators.tree_intervals import places
from sightings.session import staged

PLACE = "place"


def default_key() -> Column:
    """Year, month, record id; records without a year or month last, as ``paging.default_order`` has them."""
    return F.struct(
        F.col("year").isNull().alias("no_year"), F.col("year"), F.col("month").isNull().alias("no_month"), F.col("month"), F.col("recordid"))


class SortedCopy:
    """A table's rows with their place in an order, at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def write(cls, df: DataFrame, path: str, key: Column) -> SortedCopy:
        """Sorts df by a key that tells its rows apart and compares in the wanted order; no task sorts more than a range."""
        placed = places(df.withColumn("sortkey", key), "sortkey", PLACE)
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed.repartitionByRange(parts, PLACE).sortWithinPartitions(PLACE).write.parquet(f"{path}/rows")
        copy = cls(df.sparkSession, path)
        of_file = copy.all().select(F.col("_metadata.file_path").alias("file"), PLACE).groupBy("file")
        of_file.agg(F.min(PLACE).alias("low"), F.max(PLACE).alias("high")).coalesce(1).write.parquet(f"{path}/files")
        return copy

    def all(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def files(self) -> DataFrame:
        return self.spark.read.schema("file string, low bigint, high bigint").parquet(f"{self.path}/files")

    def total(self) -> int:
        return self.files().agg(F.coalesce(F.max("high"), F.lit(0)).alias("n")).first().n

    def _between(self, low: int, high: int) -> DataFrame:
        found = [r.file for r in self.files().where((F.col("low") <= high) & (F.col("high") >= low)).select("file").collect()]
        if not found:
            return self.all().where(F.lit(False))
        return self.spark.read.schema(self.all().schema).parquet(*found).where(F.col(PLACE).between(low, high))

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows offset + 1 to offset + limit, in order."""
        if offset < 0 or limit < 0:
            raise ValueError("offset and limit must not be negative")
        return self._between(offset + 1, offset + limit).orderBy(PLACE).drop(PLACE, "sortkey")

    def slices(self, many: int) -> list[DataFrame]:
        """The rows in so many contiguous slices of about the same size, in order."""
        total = self.total()
        cuts = [total * k // many for k in range(many + 1)]
        return [self._between(a + 1, b).orderBy(PLACE).drop(PLACE, "sortkey") for a, b in zip(cuts, cuts[1:])]


def cursor_of(row_key: object) -> str:
    """A key (a row of the key's fields) as text that a client can hand back."""
    return json.dumps(list(row_key))


def page_after(df: DataFrame, key: Column, cursor: str | None, limit: int, bounds: Column | None = None) -> tuple[DataFrame, str | None]:
    """The rows after a cursor, and the cursor after them (None at the end): a top-k over what lies behind.

    ``bounds`` is an optional plain condition that is true for all rows behind the cursor and reaches the scan.
    """
    keyed = df.withColumn("sortkey", key)
    if cursor is not None:
        fields = keyed.schema["sortkey"].dataType.fields
        after = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(json.loads(cursor), fields, strict=True)])
        keyed = keyed.where(F.col("sortkey") > after)
        keyed = keyed if bounds is None else keyed.where(bounds)
    found = staged(keyed.orderBy("sortkey").limit(limit), "page")
    last = found.agg(F.max("sortkey").alias("last"), F.count("*").alias("n")).first()
    page = found.orderBy("sortkey").drop("sortkey")
    return page, cursor_of(last["last"]) if last.n == limit and limit else None
