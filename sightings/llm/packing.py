"""Operator 8: best-fit packing of token sequences, decreasing, with a segment tree over remaining capacities.

Pieces of one length are interchangeable, so best-fit decreasing runs over the counts of the lengths (no more of
them than the capacity) instead of over documents: the tree finds the tightest open bins for a length in
logarithmic time, and a whole run of equal pieces goes into a whole run of equal bins.  The placements are those of
best-fit decreasing over single pieces.  What comes out are ranges ("the k-th to l-th pieces of length s go to
these bins at this offset"), whose number depends on the capacity and not on the data; they are joined with the
pieces, which are numbered within their length by counts of hashed parts, so that no length is sorted in one task.

Defined cases: a null text is empty and has the end id alone; no rows give no rows; rows of one id are separate
documents, told apart by their text, and rows that repeat entirely are packed as often as they occur.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightings.llm.chunk_tokens import encoder, texts_of
from sightings.llm.common import documents
from sightings.session import staged

CAPACITY = 2048
END = 0
# Pieces of one length are numbered in hashed parts: so many at least, and one for so many pieces.
PARTS, PART_ROWS = 64, 1_000_000
# Rows of an Arrow batch that a task hands back.
ROWS = 5000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class CapacityTree:
    """Remaining capacities that some open bin has; the least one of at least a given size by descent."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.used = [False] * (2 * self.width)

    def set(self, capacity: int, present: bool) -> None:
        at = capacity + self.width
        self.used[at] = present
        while at > 1:
            at //= 2
            self.used[at] = self.used[2 * at] or self.used[2 * at + 1]

    def tightest(self, size: int) -> int | None:
        at = size + self.width
        while not self.used[at]:  # up to the first subtree on the right that has something
            while at & 1:
                at //= 2
            if at == 0:
                return None
            at += 1
            if at & (at - 1) == 0:  # past the right edge
                return None
        while at < self.width:
            at = 2 * at if self.used[2 * at] else 2 * at + 1
        return at - self.width


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Placements (length, first rank, pieces, pieces per bin, first bin, offset) and the number of bins.

    Piece k of a placement (from 0) goes to bin first + k // per_bin at offset + (k % per_bin) * length.
    """
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: runs (first bin, bins)
    placed, bins = [], 0

    def leave(room: int, first: int, many: int) -> None:
        if room and many:
            open_bins.setdefault(room, []).append((first, many))
            tree.set(room, True)

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        rank, rest = 0, counts[size]
        while rest:
            room = tree.tightest(size)
            if room is None:
                room, first = capacity, bins
                many = -(-rest // (capacity // size))
                bins += many
            else:
                first, many = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    tree.set(room, False)
            each = room // size  # after one piece the same bin is the tightest that fits
            pieces = min(rest, many * each)
            full, last = divmod(pieces, each)
            placed.append((size, rank, pieces, each, first, capacity - room))
            leave(room - each * size, first, full)
            if last:
                leave(room - last * size, first + full, 1)
            begun = full + bool(last)
            leave(room, first + begun, many - begun)
            rank, rest = rank + pieces, rest - pieces
    return placed, bins


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to pieces; a long document's first piece has what the full ones leave."""
    tail = np.array([end], "<u4").tobytes()
    doc_ids: deque[int | None] = deque()
    rows: list[tuple] = []
    for tokens in encoder(path, False).encode_arrays(texts_of(batches, doc_ids)):
        doc_id = doc_ids.popleft()
        tokens += tail
        total = len(tokens) // 4
        cut = total % capacity or min(total, capacity)
        for piece, (a, b) in enumerate(zip([0, *range(cut, total, capacity)], [*range(cut, total + 1, capacity)], strict=True)):
            rows.append((doc_id, piece, a, b - a, crc32(tokens[4 * a : 4 * b])))
        if len(rows) >= ROWS:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents; texts are tokenised where they are read."""
    cut = partial(_pieces, path=path, capacity=capacity, end=end)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows with a ``length`` of 1 to capacity, with sequence_id and offset: best fit over all of them.

    ``pieces`` is read more than once and should be a written table.
    """
    spark = pieces.sparkSession
    parts = max(PARTS, -(-pieces.count() // PART_ROWS))
    numbered = pieces.withColumn("_part", F.pmod(F.xxhash64(*pieces.columns), F.lit(parts)).cast("int"))
    sizes = numbered.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n"))
    # one row per length: no more of them than the capacity
    counts = {size: n for size, n in sizes.groupBy("length").agg(F.sum("n")).collect()}
    placed, _ = best_fit(counts, capacity)
    lows: dict[int, list[int]] = {}
    for size, first, *_ in placed:
        lows.setdefault(size, []).append(first)
    starts = spark.createDataFrame(list(lows.items()), "length bigint, _lows array<bigint>")
    ranges = spark.createDataFrame(placed, "length bigint, _low bigint, _n bigint, _each bigint, _first bigint, _offset bigint")
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_part").orderBy(*[c for c in pieces.columns if c != "length"])
    ranked = numbered.withColumn("_in_part", F.row_number().over(own) - 1).join(offsets, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_in_part"))
    # both small tables have a row per length and per placement: the capacity bounds them, whatever the input
    at = F.expr("element_at(filter(_lows, x -> x <= _rank), -1)")
    ranked = ranked.join(F.broadcast(starts), "length").withColumn("_low", at)
    out = ranked.join(F.broadcast(ranges.drop("_n")), ["length", "_low"])
    step = F.col("_rank") - F.col("_low")
    bin_of = F.col("_first") + F.floor(step / F.col("_each")).cast("bigint")
    offset = F.col("_offset") + (step % F.col("_each")) * F.col("length")
    return out.select(*pieces.columns, bin_of.alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    return pack(staged(cut_pieces(docs, path, capacity, end), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
