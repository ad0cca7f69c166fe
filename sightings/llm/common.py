"""Shared by the operators of this folder: the documents table, names that clash with nothing, held-out rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.session import configure

# Rows in a batch of the Parquet reader and of Arrow: texts may be long, so batches are kept small.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxRecordsPerBatch": "500"}


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores behind it until no taken name is the same in any case."""
    lower, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in lower:
            name += "_"
        lower.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves no rest by five; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def text_hash(text: Column) -> Column:
    """Tells rows of one id apart by their texts; null as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_rows(docs: DataFrame, keepers: DataFrame, mark: Column, kept_id: str, kept_mark: str) -> DataFrame:
    """The rows of docs whose id and ``mark`` are some keeper's, in docs' own columns; of repeated rows one.

    Null ids are equal.  The keys are columns of both sides, so that rows with the same keys meet in the join's
    partition, where one of them is taken: the texts are shuffled once.
    """
    none, number, hashed = keys = unused([*docs.columns, *keepers.columns], "no_id", "keeper_id", "keeper_mark")

    def keyed(rows: DataFrame, row_id: str, row_mark: Column) -> DataFrame:
        of_id = F.col(row_id).cast("bigint")
        return rows.withColumns({none: of_id.isNull(), number: F.coalesce(of_id, F.lit(0)), hashed: row_mark})

    named = keyed(keepers, kept_id, F.col(kept_mark)).select(*keys)
    return keyed(docs, "doc_id", mark).join(named, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


# Rows of a part, about: a part of long texts is sorted by one task, on disk where it must.
PART_ROWS = 200_000


def default_parts(docs: DataFrame) -> int:
    """Twice the shuffle partitions, and more where parts would get too many rows."""
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PART_ROWS))


def id_bounds(docs: DataFrame, parts: int) -> list[int]:
    """At most parts - 1 ids that cut the ascending ids into runs of about the same number of rows."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    accuracy = max(10_000, 4 * parts)
    found = docs.select(F.percentile_approx(F.col("doc_id").cast("bigint"), shares, accuracy)).first()[0]
    return sorted(set(found or []))


def part_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the id, by bisection of an array; a null id is before all."""
    depth = len(bounds).bit_length()
    filled = bounds + [(1 << 63) - 1] * ((1 << depth) - 1 - len(bounds))
    if not filled:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, filled))), ",").cast("array<bigint>")  # folded to one constant
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(depth))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= doc_id, at + step).otherwise(at))
    return F.least(found, F.lit(len(bounds)))


def plain_texts(batches: Iterable[pd.Series]) -> Iterator[str]:
    """The texts of a column's batches, null as empty."""
    return (text or "" for texts in batches for text in texts)


def frames(rows: Iterable[tuple], columns: list[str], size: int = 1000) -> Iterator[pd.DataFrame]:
    """Rows in frames, for a column function that reads its batches ahead."""
    rows = iter(rows)
    while some := list(islice(rows, size)):
        yield pd.DataFrame(some, columns=columns)
