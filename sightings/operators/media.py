"""Media index: the media of a taxon in chunks of fixed size, and pages over them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightings.operators.hot import hot_groups, lookup
from sightings.session import staged

MAX_PAGE = 100
KEYS = ["checklistkey", "taxonkey", "mediatype"]
# Rows from which a taxon's items are not brought together, and rows of such taxa that one task sorts, about.
HOT_ROWS, TASK_ROWS = 100_000, 500_000


def _of_taxa(items: DataFrame) -> DataFrame:
    """A row per item and taxon."""
    return items.select("*", F.explode("taxonkeys").alias("checklistkey", "keys")).select(
        "*", F.explode(F.array_distinct("keys")).alias("taxonkey")).drop("taxonkeys", "keys")


def _chunked(placed: DataFrame, *keys: str) -> DataFrame:
    item = F.struct("recordid", "identifier", "title", "license", "created", "creator").alias("item")
    ordered = F.array_sort(F.collect_list(F.struct("place", item)))
    grouped = placed.groupBy(*keys, "chunk").agg(F.max("total").alias("total"), ordered.alias("placed"))
    return grouped.select(*KEYS, "chunk", "total", F.transform("placed", lambda x: x["item"]).alias("items"))


def _starts(sizes: DataFrame, hot: DataFrame, buckets: int) -> DataFrame:
    """Per hot group its rows and, for every bucket, the rows of the buckets before it."""
    none = hot.select(*KEYS, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets).cast("bigint"))).alias("_bucket"), F.lit(0).cast("bigint").alias("_n"))
    summed = sizes.unionByName(none).groupBy(*KEYS, "_bucket").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy(*KEYS).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = summed.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_start"))), lambda x: x["_start"])
    return placed.groupBy(*KEYS).agg(F.sum("_n").alias("total"), starts.alias("_starts"))


def _of_key(items: DataFrame, checklist: str, taxon: str, media_type: str) -> DataFrame:
    """The items of one taxon and type, which keep that taxon alone."""
    mine = items.where((F.col("mediatype") == media_type.lower()) & F.array_contains(F.try_element_at("taxonkeys", F.lit(checklist)), taxon))
    return mine.withColumn("taxonkeys", F.create_map(F.lit(checklist), F.array(F.lit(taxon))))


def media_index(records: DataFrame, media: DataFrame, chunk_size: int, hot_rows: int = HOT_ROWS, task_rows: int = TASK_ROWS,
                only: tuple[str, str, str] | None = None) -> DataFrame:
    """Per checklist, taxon and media type: chunks of media items and the total.

    The order of items is that of the hash of record and media identifier, the same in every taxon.  The media of
    a kingdom may be a third of all media, and so may those of one record: for hot taxa the items are dealt out
    once by ranges of the hash, before they are repeated for their taxa, and a bucket's places start behind
    the counted rows of the buckets before it.  A chunk inside a bucket is collected where it lies; only the rows of
    chunks that a border cuts move again.  The other taxa are numbered whole.

    ``only`` names the checklist, taxon and type that will be read.  A filter on the index does not get below the
    join, the counting and the dealing out of items, which have all their taxa there; this one does, and the chunks
    of that key are the same.
    """
    typed = media.filter("type IS NOT NULL").withColumn("mediatype", F.lower("type"))
    joined = records.select("recordid", "taxonkeys").join(typed, "recordid").select(
        "recordid", "taxonkeys", "mediatype", "identifier", "title", "license", "created", "creator")
    # staged, the join and the JSON behind it run once; an item stands there once, whatever its taxa
    items = staged(_of_key(joined, *only) if only else joined, "media")
    digest = F.md5(F.concat_ws("|", "recordid", "identifier"))
    in_chunk = F.floor((F.col("place") - 1) / chunk_size).cast("int")
    hot, groups = hot_groups(_of_taxa(items.select("taxonkeys", "mediatype")), KEYS, hot_rows)

    rows = _of_taxa(items)
    if groups:
        rows = lookup(rows, hot.select(*KEYS), groups, KEYS, "left_anti")
    group = Window.partitionBy(*KEYS)
    # the hash is made behind the shuffle
    whole = rows.repartition(*KEYS).withColumn("_hash", digest)
    place = F.row_number().over(group.orderBy("_hash", "recordid", "identifier")).cast("bigint")
    cold = whole.withColumn("place", place).withColumn("total", F.count("*").over(group)).withColumn("chunk", in_chunk)
    if groups == 0:
        return _chunked(cold, *KEYS)

    partitions = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(partitions, math.ceil(hot.agg(F.sum("_rows")).first()[0] / task_rows))
    buckets = 4 * tasks  # several a task, so that tasks are of like size
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    bucket: Column = F.shiftright(number * F.lit(buckets).cast("bigint"), 32).alias("_bucket")
    counted = lookup(_of_taxa(items.select("taxonkeys", "mediatype", bucket)), hot.select(*KEYS), groups, KEYS, "left_semi")
    starts = staged(_starts(counted.groupBy(*KEYS, "_bucket").agg(F.count("*").alias("_n")), hot, buckets), "starts")
    dealt = _of_taxa(items.select("*", bucket).repartition(tasks, "_bucket").withColumn("_hash", digest))
    part = Window.partitionBy("_bucket", *KEYS).orderBy("_hash", "recordid", "identifier")
    start, end = F.get("_starts", F.col("_bucket").cast("int")), F.get("_starts", (F.col("_bucket") + 1).cast("int"))
    flagged = lookup(dealt, starts, groups, KEYS, "inner").withColumn("_start", start).withColumn("_end", end).drop("_starts")
    placed = flagged.withColumn("place", F.col("_start") + F.row_number().over(part)).withColumn("chunk", in_chunk)
    first = F.col("chunk").cast("bigint") * chunk_size
    inside = (first >= F.col("_start")) & (F.least(first + chunk_size, F.col("total")) <= F.col("_end"))
    kept = _chunked(placed.where(inside), "_bucket", *KEYS).unionByName(_chunked(placed.where(~inside), *KEYS))
    return kept.unionByName(_chunked(cold, *KEYS))


def media_page(index: DataFrame, checklist: str, taxon: str, media_type: str, limit: int, offset: int, chunk_size: int,
               max_limit: int = MAX_PAGE) -> DataFrame:
    """Items offset … offset+limit of one taxon and type, reading only the chunks that hold them."""
    limit = min(limit, max_limit)
    first, last = offset // chunk_size, (offset + limit - 1) // chunk_size
    chunks = index.filter(
        (F.col("checklistkey") == checklist) & (F.col("taxonkey") == taxon) & (F.col("mediatype") == media_type.lower())
        & F.col("chunk").between(first, last))
    items = chunks.select("chunk", "total", F.posexplode("items").alias("pos", "item"))
    place = F.col("chunk") * chunk_size + F.col("pos")
    return items.select(place.alias("position"), "total", "item.*").filter(
        (F.col("position") >= offset) & (F.col("position") < offset + limit))
