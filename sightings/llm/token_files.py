"""Operator 3: token ids in a compact file format, patched frame-of-reference blocks.

Ids are cut into blocks.  A block stores its minimum, the differences to it packed at the bit width that a
percentile of them needs, and a list of exceptions (place and whole difference) for those that need more; of the
percentiles tried, the one that makes the block smallest is taken.  Blocks follow each other in segments of whole
documents, with the byte at which each block starts, so any block can be read alone.

On disk a segment is a row of Parquet, so any store that Spark writes to will do and a lost executor's part is
written again: shard, segment, first (ids before it in its shard), doc_ids, doc_starts, block_starts, payload.
Shards are runs of ascending ids; a table with a row per shard has the ids before it.

A block's bytes, little-endian: minimum u32, values u16, exceptions u16, width u8, packed bits (most significant
first, padded to a byte), exceptions' places u16 each, their differences u32 each.

Defined cases: a null text is empty and has the end id alone; rows of one id are separate documents, ordered by
their text, a null id comes first; no rows make no segments.
"""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.llm.chunk_tokens import encoder, texts_of
from sightings.llm.common import default_parts, documents, id_bounds, part_of
from sightings.session import scratch_path

BLOCK = 512
SEGMENT = 1 << 16
END = 1
PERCENTILES = (50, 75, 90, 95, 99, 100)
_HEAD = struct.Struct("<IHHB")
SEGMENTS = "shard int, segment int, first bigint, n_ids bigint, doc_ids array<bigint>, doc_starts array<bigint>, block_starts array<int>, payload binary"


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values (k, n) as rows of bytes, ``width`` bits each."""
    bits = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(*values.shape, 4), axis=2)
    return np.packbits(bits[:, :, 32 - width :].reshape(len(values), -1), axis=1)


def pack_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, list[int]]:
    """The blocks of some ids, and the byte at which each starts."""
    if not len(ids):
        return b"", []
    count = -(-len(ids) // block)
    table = np.full(count * block, ids[-1], "<u4")  # the last block is filled up for the arithmetic only
    table[: len(ids)] = ids
    table = table.reshape(count, block)
    low = table.min(1)
    rest = table - low[:, None]
    need = np.sort(_bits(rest), axis=1)
    places = [max(0, -(-block * p // 100) - 1) for p in PERCENTILES]
    widths = need[:, places]
    over = (need[:, None, :] > widths[:, :, None]).sum(2)
    cost = block * widths + 48 * over
    width = np.take_along_axis(widths, cost.argmin(1)[:, None], 1)[:, 0]
    out: list[bytes] = [b""] * count
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        values = rest[rows]
        outside = _bits(values) > w
        small = np.where(outside, 0, values)
        body = _packed(small, int(w)) if w else np.zeros((len(rows), 0), np.uint8)
        for k, row in enumerate(rows.tolist()):
            n = min(block, len(ids) - row * block)
            at = np.flatnonzero(outside[k, :n])
            head = _HEAD.pack(int(low[row]), n, len(at), int(w))
            size = -(-n * int(w) // 8)
            out[row] = head + body[k, :size].tobytes() + at.astype("<u2").tobytes() + values[k, at].astype("<u4").tobytes()
    starts = np.cumsum([0, *map(len, out[:-1])]).tolist()
    return b"".join(out), starts


def read_block(payload: bytes, start: int) -> np.ndarray:
    """The ids of the block at a byte of the payload."""
    low, n, n_over, width = _HEAD.unpack_from(payload, start)
    start += _HEAD.size
    size = -(-n * width // 8)
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, size, start))[: n * width].reshape(n, width)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, 32 - width :] = bits
    values = np.packbits(whole, axis=1).view(">u4").ravel().astype("<u4")
    at = np.frombuffer(payload, "<u2", n_over, start + size)
    values[at] = np.frombuffer(payload, "<u4", n_over, start + size + 2 * n_over)
    return values + np.uint32(low)


def read_blocks(payload: bytes, starts: list[int]) -> np.ndarray:
    return np.concatenate([read_block(payload, s) for s in starts]) if starts else np.zeros(0, "<u4")


def _segments(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) in order to segments of this task's shard."""
    shard, segment, first = TaskContext.get().partitionId(), 0, 0
    tail = np.array([end], "<u4").tobytes()
    doc_ids: list[int | None] = []
    starts: list[int] = []
    held: list[bytes] = []
    size = 0

    def closed() -> pa.RecordBatch:
        payload, blocks = pack_blocks(np.frombuffer(b"".join(held), "<u4"))
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        row = [shard, segment, first, size, doc_ids, starts, blocks, payload]
        names = ["shard", "segment", "first", "n_ids", "doc_ids", "doc_starts", "block_starts", "payload"]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

    ids_in_turn: deque[int | None] = deque()
    for ids in encoder(path, True).encode_arrays(texts_of(batches, ids_in_turn)):
        doc_ids.append(ids_in_turn.popleft())
        starts.append(size)
        held.append(ids + tail)
        size += len(ids) // 4 + 1
        if size >= SEGMENT:
            yield closed()
            segment, first, size = segment + 1, first + size, 0
            doc_ids, starts, held = [], [], []
    if held:
        yield closed()


def write(docs: DataFrame, folder: str, path: str, end: int = END, shards: int | None = None) -> None:
    """Tokenises the documents in ascending id order and writes ``folder``/segments and ``folder``/shards."""
    spark = docs.sparkSession
    bounds = id_bounds(docs, shards or default_parts(docs))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.withColumn("part", part_of(F.col("doc_id"), bounds)).repartitionById(len(bounds) + 1, "part")
    rows = rows.sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    rows.mapInArrow(partial(_segments, path=path, end=end), SEGMENTS).write.parquet(f"{folder}/segments")
    sizes = spark.read.parquet(f"{folder}/segments").groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()  # a row per shard
    total, index = 0, []
    for shard, n in sorted(sizes):
        index.append((shard, total, n))
        total += n
    spark.createDataFrame(index, "shard int, before bigint, n_ids bigint").coalesce(1).write.parquet(f"{folder}/shards")


def _documents(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = read_blocks(row["payload"], row["block_starts"])
            begins = row["doc_starts"]
            ends = [*begins[1:], len(ids)]
            parts = [ids[a:b] for a, b in zip(begins, ends, strict=True)]
            before = row["before"] + row["first"]
            columns = [
                pa.array(row["doc_ids"], pa.int64()),
                pa.array([before + a for a in begins], pa.int64()),
                pa.array([len(x) for x in parts], pa.int64()),
                pa.array([crc32(x.tobytes()) for x in parts], pa.int64()),
            ]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files; segments are read independently."""
    shards = spark.read.schema("shard int, before bigint, n_ids bigint").parquet(f"{folder}/shards").drop("n_ids")
    rows = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments").join(F.broadcast(shards), "shard")  # a row per shard
    rows = rows.select("before", "first", "doc_ids", "doc_starts", "block_starts", "payload")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return rows.mapInArrow(partial(_documents, with_ids=with_ids), schema)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    folder = scratch_path(spark, "token-files")
    write(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, folder, with_ids=False)
