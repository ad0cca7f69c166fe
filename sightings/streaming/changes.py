"""Changes of registry objects: what changed, what has to be done, for which records.

Every rule is a column over one row holding the old and the new object, so the same
code runs on a snapshot comparison and on a stream of change messages.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightings.session import scratch_path

# Endpoints that can be crawled, and the two waiting times.
CRAWLABLE = ("BIOCASE", "BIOCASE_XML_ARCHIVE", "CAMTRAP_DP", "DIGIR", "DIGIR_MANIS", "TAPIR", "DWC_ARCHIVE", "EML")
NEW_DATASET_MINUTES = 3
RECENT_SECONDS = 5

CREATED, UPDATED, DELETED, COMPONENT = "CREATED", "UPDATED", "DELETED", "UPDATE_COMPONENT"
DELETE, CRAWL, METADATA, METADATA_LOCATION = "DELETE", "CRAWL", "METADATA", "METADATA+LOCATION"


def _changed(old: str, new: str, field: str) -> Column:
    return ~F.col(f"{old}.{field}").eqNullSafe(F.col(f"{new}.{field}"))


def _set_changed(old: str, new: str, field: str) -> Column:
    """Compared as sets; a missing list is an empty one."""
    empty = F.array().cast("array<string>")

    def as_set(side: str) -> Column:
        return F.array_sort(F.array_distinct(F.coalesce(F.col(f"{side}.{field}"), empty)))

    return as_set(old) != as_set(new)


def license_changed(old: str, new: str, at: Column) -> Column:
    """A changed licence counts only for datasets created at least three minutes before."""
    changed = F.col(f"{old}.license").isNotNull() & _changed(old, new, "license")
    fresh = F.col(f"{old}.created") > at - F.expr(f"INTERVAL {NEW_DATASET_MINUTES} MINUTES")
    return changed & ~F.coalesce(fresh, F.lit(False))


def dataset_requires_update(old: str, new: str, at: Column) -> Column:
    plain = ("publishingorgkey", "projectid", "title", "installationkey")
    tests = [_changed(old, new, f) for f in plain]
    tests += [_set_changed(old, new, f) for f in ("networkkeys", "category")]
    out = license_changed(old, new, at)
    for test in tests:
        out = out | test
    return F.coalesce(out, F.lit(False))


def organisation_requires_update(old: str, new: str) -> Column:
    """An organisation without endorsement has no records; else its country or title counts."""
    return F.coalesce(F.col(f"{new}.endorsed"), F.lit(False)) & (_changed(old, new, "country") | _changed(old, new, "title"))


def newly_endorsed(old: str, new: str) -> Column:
    return ~F.coalesce(F.col(f"{old}.endorsed"), F.lit(False)) & F.coalesce(F.col(f"{new}.endorsed"), F.lit(False))


def installation_requires_update(old: str, new: str) -> Column:
    return _changed(old, new, "organizationkey")


def _shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def _arrow(old: str, new: str, field: str) -> Column:
    return F.concat(F.lit("["), _shown(F.col(f"{old}.{field}")), F.lit("] -> ["), _shown(F.col(f"{new}.{field}")), F.lit("]"))


def dataset_message(old: str, new: str) -> Column:
    return F.concat(
        F.lit("Dataset ["), _shown(F.col(f"{old}.key")), F.lit("]: Publishing Organization "), _arrow(old, new, "publishingorgkey"),
        F.lit(", License "), _arrow(old, new, "license"))


def organisation_message(old: str, new: str) -> Column:
    return F.concat(F.lit("Publishing Organization ["), _shown(F.col(f"{old}.key")), F.lit("]: Country "), _arrow(old, new, "country"))


def update_message(dataset_changed: Column, organisation_changed: Column | None = None) -> Column:
    """Texts of what changed, the organisation's first; null when nothing did."""
    parts = []
    if organisation_changed is not None:
        parts.append(F.when(organisation_changed, organisation_message("oldorg", "neworg")))
    parts.append(F.when(dataset_changed, dataset_message("old", "new")))
    text = F.concat_ws(",", *parts)
    return F.when(text != "", text)


def snapshot_changes(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Two snapshots as change rows: ``changetype``, ``old`` and ``new`` (structs)."""
    before = old.select(F.col(key).alias("_key"), F.struct(*old.columns).alias("old"))
    after = new.select(F.col(key).alias("_key"), F.struct(*new.columns).alias("new"))
    both = before.join(after, "_key", "full_outer")
    kind = F.when(F.col("old").isNull(), CREATED).when(F.col("new").isNull(), DELETED).otherwise(UPDATED)
    return both.select(F.col("_key").alias("key"), kind.alias("changetype"), "old", "new")


def crawlable(endpoints: Column) -> Column:
    return F.coalesce(F.arrays_overlap(endpoints, F.array(*map(F.lit, CRAWLABLE))), F.lit(False))


def dataset_actions(at: Column) -> Column:
    """Actions for a dataset change row, an empty array for none.

    Crawling a recently crawled dataset again is prevented by ``first_per_window``.
    """
    none = F.array().cast("array<string>")
    updated = F.when(dataset_requires_update("old", "new", at), F.array(F.lit(CRAWL), F.lit(METADATA))).otherwise(F.array(F.lit(CRAWL)))
    kind = F.col("changetype")
    can_crawl = crawlable(F.col("new.endpoints"))
    return (
        F.when(kind == DELETED, F.array(F.lit(DELETE)))
        .when(kind == COMPONENT, F.array(F.lit(METADATA)))
        .when((kind == UPDATED) & can_crawl, updated)
        .when((kind == CREATED) & can_crawl, F.array(F.lit(CRAWL)))
        .otherwise(none)
    )


def organisation_action() -> Column:
    """Crawl the datasets of a newly endorsed organisation; reinterpret those of a changed one."""
    return F.when(F.col("changetype") == UPDATED, F.when(newly_endorsed("old", "new"), CRAWL).when(
        organisation_requires_update("old", "new"), METADATA_LOCATION))


def installation_action() -> Column:
    return F.when((F.col("changetype") == UPDATED) & installation_requires_update("old", "new"), METADATA)


def affected_datasets(datasets: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Datasets owned by (or hosted by) the changed objects."""
    return datasets.join(changed.select(key).distinct(), key, "left_semi")


def network_datasets(datasets: DataFrame, deleted: DataFrame) -> DataFrame:
    """Datasets of the deleted networks, one row per dataset and network."""
    members = datasets.select("key", F.explode("networkkeys").alias("networkkey"))
    return members.join(deleted.select("networkkey"), "networkkey").select("key", "networkkey")


def affected_records(records: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Records of the changed owners; the owners' keys are few, the records are not moved twice."""
    return records.join(changed.select(key).distinct(), key, "left_semi")


# ---- stream ---------------------------------------------------------------------------------------------

def first_per_window(messages: DataFrame, key: str, time: str, seconds: int = RECENT_SECONDS) -> DataFrame:
    """A message of a key is passed on unless one was passed less than ``seconds`` before.

    State is one time per key and is dropped once the watermark is past the window.  A
    micro-batch bounds what a key brings at once; set the source's limit per trigger.
    """
    watermarked = messages.withWatermark(time, f"{seconds} seconds")
    schema = watermarked.select(key, time).schema

    def passed(group: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        # only times are held, and the search jumps from one passed message to the next
        times = np.sort(np.concatenate([batch[time].to_numpy("datetime64[us]").view(np.int64) for batch in batches]))
        kept, at = [], 0
        while at < len(times):
            at = at if last is None else max(at, int(np.searchsorted(times, last + seconds * 1_000_000)))
            if at < len(times):
                last = int(times[at])
                kept.append(pd.Timestamp(last, unit="us"))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        if kept:
            yield pd.DataFrame({key: [group[0]] * len(kept), time: kept})

    return watermarked.select(key, time).groupBy(key).applyInPandasWithState(
        passed, schema, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is available and write each micro-batch to its own folder.

    A repeated micro-batch overwrites its folder, so a restart after a lost driver or
    executor neither loses nor doubles rows.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def passed_messages(messages: DataFrame, key: str, time: str, seconds: int = RECENT_SECONDS) -> DataFrame:
    """Run ``first_per_window`` over everything available and read the result."""
    spark = messages.sparkSession
    path = scratch_path(spark, "passed")
    kept = first_per_window(messages, key, time, seconds)
    run_to_table(kept, path, scratch_path(spark, "passed-state"))
    return spark.read.schema(kept.schema).parquet(f"{path}/batch=*")
