"""Plain record counts by dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_where(df: DataFrame, condition: Column | None = None) -> DataFrame:
    rows = df if condition is None else df.filter(condition)
    return rows.agg(F.count("*").alias("count"))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count"))


def count_by_year(df: DataFrame, first: int, last: int) -> DataFrame:
    return count_by(df.filter(F.col("year").between(first, last)), "year")


def publishing_countries(df: DataFrame, country: str) -> DataFrame:
    """Who publishes records of a country."""
    return count_by(df.filter((F.col("countrycode") == country) & F.col("publishingcountry").isNotNull()), "publishingcountry")


def countries_published(df: DataFrame, publisher: str) -> DataFrame:
    """The countries a publisher's records are from."""
    return count_by(df.filter((F.col("publishingcountry") == publisher) & F.col("countrycode").isNotNull()), "countrycode")


def datasets_where(df: DataFrame, condition: Column) -> DataFrame:
    """Datasets with matching records, the largest first."""
    return count_by(df.filter(condition), "datasetkey").orderBy(F.desc("count"), "datasetkey")
