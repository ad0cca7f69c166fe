"""Order, pages, point lookups and export slices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightings.operators.hot import hashed_number

# Page limits of a search.
MAX_PAGE = 300
MAX_RESULT_WINDOW = 100_000
SHUFFLE_RANGE = 1_000_000
# Rows of an export slice that one task sorts.
SLICE_ROWS = 1_000_000


def by_id(df: DataFrame, record_id: str) -> DataFrame:
    return df.filter(F.col("recordid") == record_id).limit(1)


def by_record(df: DataFrame, dataset: str, occurrence_id: str) -> DataFrame:
    """First record of a dataset and the id that its publisher gave it."""
    same = (F.col("datasetkey") == dataset) & (F.col("occurrenceid") == occurrence_id)
    return df.filter(same).orderBy("recordid").limit(1)


def default_order() -> list[Column]:
    """Year, month, record id; records without a year or month come last."""
    return [F.col("year").asc_nulls_last(), F.col("month").asc_nulls_last(), F.col("recordid").asc()]


def shuffled_order(seed: str) -> list[Column]:
    """A stable permutation per seed: the same seed always gives the same order."""
    place = F.pmod(hashed_number(F.col("recordid"), seed), F.lit(SHUFFLE_RANGE))
    return [place, F.col("recordid")]


def checked_page(offset: int, limit: int, window: int = MAX_RESULT_WINDOW) -> tuple[int, int]:
    """The limit is clamped to a page; an end beyond the window is an error."""
    limit = min(limit, MAX_PAGE)
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    if offset + limit > window:
        raise ValueError(f"offset {offset} plus limit {limit} is above {window}")
    return offset, limit


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 20) -> DataFrame:
    """One page in order: planned as a top-k, each task keeps offset+limit rows at most."""
    offset, limit = checked_page(offset, limit)
    return df.orderBy(*order).offset(offset).limit(limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def export_slices(df: DataFrame, slices: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows in descending id order, cut into contiguous ranges, one per output file.

    A slice of more than ``slice_rows`` rows is cut again, into files that follow each other, so that no task
    sorts more than about so many.
    """
    newest_first = F.col("recordid").desc()
    files = slices * max(1, math.ceil(df.count() / (slices * slice_rows)))
    return df.repartitionByRange(files, newest_first).sortWithinPartitions(newest_first)
