"""Reading and building the base tables, and publishing a rebuilt one."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightings.functions.text import clean_delimiters, clean_delimiters_array, media_items
from sightings.model import SNAPSHOT_SCHEMA
from sightings.plans.terms import MEDIA_COLUMNS
from sightings.sources.versions import VersionLog


def read_records(spark: SparkSession, path: str, schema: str = SNAPSHOT_SCHEMA) -> DataFrame:
    """Columnar scan with the fixed schema: nothing is inferred, files are not opened to plan."""
    return spark.read.schema(schema).parquet(path)


def build_record_table(raw: DataFrame, initialisers: Mapping[str, Column] | None = None) -> DataFrame:
    """Raw rows to the typed table: one expression per column, text cleaned of delimiters."""
    initialisers = initialisers or {}
    columns = []
    for field in raw.schema:
        c = F.col(f"`{field.name}`")
        kind = field.dataType.simpleString()
        if field.name in initialisers:
            value = initialisers[field.name]
        elif kind == "string":
            value = clean_delimiters(c)
        elif kind == "array<string>":
            value = clean_delimiters_array(c)
        else:
            value = c
        columns.append(value.alias(field.name))
    return raw.select(*columns)


def build_extension_table(raw: DataFrame, key: str = "recordid") -> DataFrame:
    """Extension rows: the key as it is, every other column as cleaned text."""
    rest = [c for c in raw.columns if c != key]
    return raw.select(key, *[clean_delimiters(F.col(f"`{c}`").cast("string")).alias(c) for c in rest])


def build_multimedia_table(records: DataFrame) -> DataFrame:
    """One row per media item; records without media vanish; the created date is left as is."""
    items = records.select("recordid", F.explode(media_items(F.col("ext_multimedia"))).alias("item"))
    values = []
    for name in MEDIA_COLUMNS:
        c = F.try_element_at("item", F.lit(name))
        values.append((c if name == "created" else clean_delimiters(c)).alias(name))
    return items.select("recordid", *values)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", codec: str = "zstd") -> None:
    df.write.mode("overwrite").format(fmt).option("compression", codec).save(path)


class PublishedTable:
    """A table in versions: data in folders of their own, and a log whose last entry is what readers get.

    A version is published by one step, the log's new entry, on the condition that the version it follows is still the
    last one.  Whatever fails before leaves the former version whole; readers of an older version keep it.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str):
        self.spark, self.name, self.folder = spark, name, folder.rstrip("/")
        self.log = VersionLog(spark, f"{self.folder}/{name}-versions")

    @property
    def version(self) -> int | None:
        current = self.log.current()
        return current.number if current else None

    def publish(self, df: DataFrame, expected: int | None, fmt: str = "parquet", codec: str = "zstd") -> int:
        """Writes df and makes it the version after ``expected``, which is None for the first one."""
        path = f"{self.folder}/{self.name}-{uuid.uuid4().hex}"
        write_table(df, path, fmt, codec)
        return self.log.commit({"path": path, "format": fmt, "schema": df.schema.jsonValue()}, expected).number

    def read(self, version: int | None = None) -> DataFrame:
        """The last version, or the one asked for."""
        found = self.log.current() if version is None else self.log.read(version)
        if found is None:
            raise LookupError(f"{self.name} has no version yet")
        return self.spark.read.schema(StructType.fromJson(found.entry["schema"])).format(found.entry["format"]).load(found.entry["path"])


def publish(df: DataFrame, name: str, folder: str) -> None:
    """Publish df as the next version, and have the names ``<name>`` and ``old_<name>`` show the last two versions.

    The names are views of the catalog on a version's folder, each replaced in one step; the former version gets its
    second name first, so no moment is without a whole ``<name>``.
    """
    spark = df.sparkSession
    table = PublishedTable(spark, name, folder)
    before = table.version
    number = table.publish(df, before)
    for view, version in ((f"old_{name}", before), (name, number)):
        if version is not None:
            spark.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM parquet.`{table.log.read(version).entry['path']}`")
