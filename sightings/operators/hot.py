"""Exact group operations that never bring one group to one task.

A group may hold a third of all rows.  Groups are counted first, which is combined
map-side and cheap; the few that are too large are spread over buckets taken from a
hash of the row's id.  Work that would need a whole group in order then runs per
bucket, and only one small row per bucket is gathered per group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightings.session import staged

# Rows up to which a group may stay in one task, and up to which a counted table is broadcast.
HOT_ROWS = 1_000_000
BROADCAST_ROWS = 100_000


def hashed_number(c: Column, salt: str) -> Column:
    """A whole number below 2**32 drawn from a text and a salt; the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", c, F.lit(salt))), 1, 8), 16, 10).cast("bigint")


def bucket_digits(spark: SparkSession) -> int:
    """Hex digits for more buckets than shuffle partitions: 256 at least, 65536 at most.

    So the hottest group still spreads over the whole cluster, whatever its size.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(4, max(2, math.ceil(math.log(4 * partitions, 16))))


def hot_groups(df: DataFrame, keys: Sequence[str], above: int) -> tuple[DataFrame, int]:
    """The keys of groups with more rows than ``above``, their rows, and how many there are.

    There are at most rows/above of them.  They are written out once, so that their
    exact number decides how they are joined.
    """
    counted = df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > above)
    hot = staged(counted, "hot")
    return hot, hot.count()


def lookup(left: DataFrame, right: DataFrame, rows: int, keys: Sequence[str], how: str) -> DataFrame:
    """Join a table of known size on keys that may be null.

    Up to ``BROADCAST_ROWS`` rows it is sent to every task, so the large side does not
    move; beyond that both sides are shuffled and the planner splits hot partitions.
    """
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    small = F.broadcast(renamed) if rows <= BROADCAST_ROWS else renamed
    return left.join(small, condition, how).drop(*[f"_r_{k}" for k in keys])


def numbered(df: DataFrame, keys: Sequence[str], *ids: str, digits: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``place`` (1, 2, …) and ``total`` per group, in the order of the ids' hash.

    ``ids`` tell the rows of a group apart.  A hot group is cut into buckets by a prefix of
    the hash: places inside a bucket come from a window over the bucket, and the running
    sum of the bucket sizes gives each bucket its start.  The places depend on
    neither ``digits`` nor ``hot_rows``.
    """
    keys = list(keys)
    hashed = df.withColumn("_hash", F.md5(F.concat_ws("|", *ids)))
    hot, groups = hot_groups(df, keys, hot_rows)
    if groups == 0:
        whole = Window.partitionBy(*keys)
        placed = hashed.withColumn("place", F.row_number().over(whole.orderBy("_hash", *ids)).cast("bigint"))
        return placed.withColumn("total", F.count("*").over(whole)).drop("_hash")

    digits = bucket_digits(df.sparkSession) if digits is None else digits
    flagged = lookup(hashed, hot.select(*keys, F.lit(True).alias("_hot")), groups, keys, "left")
    spread = flagged.withColumn("_bucket", F.when(F.col("_hot"), F.substring("_hash", 1, digits)).otherwise(""))
    part = Window.partitionBy(*keys, "_bucket")
    placed = spread.withColumn("_inside", F.row_number().over(part.orderBy("_hash", *ids))).withColumn(
        "_size", F.count("*").over(part))

    slim = hashed.select(*keys, F.substring("_hash", 1, digits).alias("_bucket"))
    sizes = lookup(slim, hot.select(*keys), groups, keys, "inner").groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
                                 F.sum("_n").over(group).alias("_whole")), "starts")
    joined = lookup(placed, starts, starts.count(), [*keys, "_bucket"], "left")
    return joined.withColumn("place", F.coalesce("_start", F.lit(0)) + F.col("_inside")).withColumn(
        "total", F.coalesce("_whole", "_size")).drop("_hash", "_hot", "_bucket", "_inside", "_size", "_start", "_whole")


def bounded_sets(df: DataFrame, key: str, record_id: str, roles: dict[str, str], max_ids: int | None = None) -> DataFrame:
    """Counts and id sets per key and role.

    ``roles`` maps an output suffix to the value of the ``role`` column.  A key gives one
    row (``part`` 0) with all its ids, whatever its size; one task puts that row together.
    Only where a caller names ``max_ids``, a key with more rows gives rows/max_ids parts by
    hash, about ``max_ids`` ids long at most, whose counts and sets add up to the whole.
    """
    measures = []
    for suffix, role in roles.items():
        mine = F.when(F.col("role") == role, F.col(record_id))
        measures += [F.count(mine).alias(f"total{suffix}"), F.collect_set(mine).alias(f"ids{suffix}")]
    if max_ids is None:
        return df.groupBy(key, F.lit(0).cast("bigint").alias("part")).agg(*measures)
    hot, groups = hot_groups(df, [key], max_ids)
    parts = hot.select(key, F.ceil(F.col("_rows") / max_ids).alias("_parts"))
    part = F.when(F.col("_parts").isNotNull(), F.pmod(hashed_number(F.col(record_id), "part"), F.col("_parts"))).otherwise(F.lit(0))
    split = lookup(df, parts, groups, [key], "left").withColumn("part", part.cast("bigint"))
    return split.groupBy(key, "part").agg(*measures)
