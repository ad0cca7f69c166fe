"""Writers of the export formats; every one writes from the executors, in parts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _line(df: DataFrame) -> DataFrame:
    """One text column: values tab separated, null as nothing, no quoting."""
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat_ws("\t", *values).alias("value"))


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    """Tab separated parts; the header line goes to a folder of its own beside them.

    A header per part would repeat when the parts are joined into one file.
    """
    _line(df).write.mode("overwrite").text(path)
    if header:
        line = df.sparkSession.createDataFrame([("\t".join(df.columns),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{path}_header")


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def avro_available(spark: SparkSession) -> bool:
    try:
        spark.read.format("avro").schema("x int").load([]).schema
        return True
    except Exception:  # the data source is an optional package
        return False


def export_format(spark: SparkSession, fmt: str, fallback: str | None = None) -> str:
    """``fmt``, or the stated fallback where it is Avro and its package is missing; without one that is an error."""
    if fmt != "avro" or avro_available(spark):
        return fmt
    if fallback is None:
        raise RuntimeError("Avro needs the optional package spark-avro; name a fallback format to go on without it")
    return fallback


def write_avro(df: DataFrame, path: str, fallback: str | None = None) -> str:
    """Avro with deflate level 9, or the stated fallback format where its package is missing. Returns the format."""
    spark = df.sparkSession
    fmt = export_format(spark, "avro", fallback)
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "avro":
        spark.conf.set("spark.sql.avro.deflate.level", "9")
    writer.option("compression", {"avro": "deflate", "orc": "zlib"}.get(fmt, "snappy")).save(path)
    return fmt


def write_fasta(df: DataFrame, path: str) -> None:
    """``df`` has one column with header and sequence separated by a line feed."""
    df.select(F.col(df.columns[0]).alias("value")).write.mode("overwrite").text(path)


def write_bundle(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> DataFrame:
    """Each table in a folder of its name; returns the manifest (table, rows, columns).

    Row counts are read back from what was written, so the manifest describes the files.
    """
    manifest = None
    for name, df in tables.items():
        target = f"{path}/{name}"
        if fmt == "tsv":
            write_tsv(df, target)
            written = df.sparkSession.read.text(target)
        else:
            df.write.mode("overwrite").format(fmt).save(target)
            written = df.sparkSession.read.format(fmt).schema(df.schema).load(target)
        row = written.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"))
        manifest = row if manifest is None else manifest.unionByName(row)
    return manifest
