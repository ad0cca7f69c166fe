"""Messages of object versions as one stream of typed changes, with the last version of each object as state.

A message has the object's type and key, a time in microseconds that orders its versions, and the object (null: it is
gone).  Messages wait in the state until the watermark has passed them and are then taken in order, so late ones
within ``delay`` find their place, and any cut into micro-batches gives the same changes.  A repeated message, and one
older than the version already taken, changes nothing.  Objects are dealt out to shards by a hash of their key; a timer
wakes a shard of which messages have become due.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from sightings.streaming.changes import CREATED, DELETED, UPDATED

_CHANGES = "objecttype string, key string, at bigint, changetype string, oldjson string, newjson string"
_STATE = "objects string"
# Parts of the keys by hash, each with one state of its objects: a call, which costs far more than an object, serves all of them.
SHARDS = 4096


def taken_in_order(taken: int | None, current: str | None, messages: list[tuple[int, str | None]]) -> tuple[int | None, str | None, list[tuple]]:
    """The state after messages (time, object) in any order, and their changes (time, kind, old, new)."""
    changes = []
    for at, made in sorted(messages, key=lambda x: (x[0], x[1] or "")):
        if taken is not None and at <= taken:
            continue
        if made is not None or current is not None:
            kind = DELETED if made is None else CREATED if current is None else UPDATED
            changes.append((at, kind, current, made))
        taken, current = at, made
    return taken, current, changes


def object_changes(messages: DataFrame, delay: str = "10 minutes", shards: int = SHARDS) -> DataFrame:
    """(objecttype, key, at, changetype, oldjson, newjson) for a stream of (objecttype, key, at, object)."""
    shard = F.pmod(F.xxhash64("objecttype", "key"), F.lit(shards)).cast("int").alias("shard")
    timed = messages.select(shard, "objecttype", "key", "at", F.timestamp_micros("at").alias("time"), F.to_json("object").alias("object"))

    def step(group: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        objects = {(kind, key): (taken, current, [tuple(x) for x in waiting]) for kind, key, taken, current, waiting in held}
        if not state.hasTimedOut:
            for batch in batches:
                made = (x if isinstance(x, str) else None for x in batch["object"])
                for kind, key, at, value in zip(batch["objecttype"].tolist(), batch["key"].tolist(), batch["at"].tolist(), made):
                    objects.setdefault((kind, key), (None, None, []))[2].append((at, value))
        watermark, soonest, changes = state.getCurrentWatermarkMs(), None, []
        for named, (taken, current, waiting) in objects.items():
            if waiting:
                waiting = set(waiting)  # repeated messages wait once
                due = [x for x in waiting if x[0] // 1000 < watermark]
                rest = sorted((x for x in waiting if x[0] // 1000 >= watermark), key=str)
                taken, current, own = taken_in_order(taken, current, due)
                objects[named] = taken, current, rest
                changes += [(*named, *c) for c in own]
                soonest = min([at for at, _ in rest] + ([] if soonest is None else [soonest]), default=None)
        state.update((json.dumps([(*named, *rest) for named, rest in objects.items()]),))
        if soonest is not None:
            state.setTimeoutTimestamp(max(soonest // 1000 + 1, watermark + 1))
        if changes:
            yield pd.DataFrame(changes, columns=["objecttype", "key", "at", "changetype", "oldjson", "newjson"])

    watermarked = timed.withWatermark("time", delay)
    return watermarked.groupBy("shard").applyInPandasWithState(step, _CHANGES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def batch_changes(messages: DataFrame) -> DataFrame:
    """The same changes of a table of messages, by ordering each object's versions; what the stream is checked against."""
    from pyspark.sql import Window

    own = messages.select("objecttype", "key", "at", F.to_json("object").alias("newjson")).groupBy("objecttype", "key", "at").agg(F.min(F.struct(F.coalesce("newjson", F.lit("")).alias("order"), "newjson")).alias("first"))
    own = own.select("objecttype", "key", "at", F.col("first.newjson").alias("newjson"))
    before = F.lag("newjson").over(Window.partitionBy("objecttype", "key").orderBy("at"))
    rows = own.withColumn("oldjson", before).where(F.col("oldjson").isNotNull() | F.col("newjson").isNotNull())
    kind = F.when(F.col("newjson").isNull(), DELETED).when(F.col("oldjson").isNull(), CREATED).otherwise(UPDATED)
    return rows.select("objecttype", "key", "at", kind.alias("changetype"), "oldjson", "newjson")


def with_objects(changes: DataFrame, schema: StructType) -> DataFrame:
    """Change rows with ``old`` and ``new`` as structs, for the rules of ``changes``."""
    return changes.withColumns({"old": F.from_json("oldjson", schema), "new": F.from_json("newjson", schema)}).drop("oldjson", "newjson")
