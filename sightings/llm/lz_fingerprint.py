"""Operator 4: Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed as in LZ78: the shortest run of bytes that is not yet in the dictionary becomes a
phrase and the next run begins.  The set of phrases, by a 32-bit hash that grows with the phrase, is what a
compressor would learn; the fingerprint keeps its ``SIZE`` least hashes after mixing.  Two fingerprints' likeness is
the share of common hashes among the least ones of both, an estimate of the sets' Jaccard likeness, and exact where
the sets are small.

A document and its edited text begin alike, so the parse of the common part is done once and goes on twice.

Defined cases: a null text is empty; an empty text has the empty fingerprint, which is like itself (1) and unlike
all others (0).  Rows are taken in the order of id (null first), then text; the last row is followed by the first,
a single row by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.llm.common import default_parts, documents, id_bounds, part_of

SIZE = 128
# FNV-1 over 32 bits: start and factor are the published ones.
_START, _FACTOR, _MASK = 0x811C9DC5, 0x01000193, 0xFFFFFFFF
ROWS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def phrases(data: bytes, seen: set[int], at: int = _START) -> int:
    """Adds the phrases of data to the set, going on from the open phrase ``at``; returns the one left open."""
    add, factor, mask, start = seen.add, _FACTOR, _MASK, _START
    for byte in data:
        at = (at * factor & mask) ^ byte
        if at not in seen:
            add(at)
            at = start
    return at


def signature(seen: set[int], size: int = SIZE) -> np.ndarray:
    """The least hashes, ascending, after a mixing that maps 32 bits one to one."""
    h = np.fromiter(seen, np.uint32, len(seen))
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    if len(h) > size:
        h = np.partition(h, size - 1)[:size]
    return np.sort(h)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    same = both[1:] == both[:-1]
    distinct = np.flatnonzero(np.r_[True, ~same])[:size]
    common = np.r_[same, False][distinct].sum()
    return float(common) / len(distinct)


def _hex(a: np.ndarray) -> str:
    return a.astype(">u4").tobytes().hex()


def fingerprint(text: str | None) -> str:
    """The fingerprint of one text, as a string of hexadecimal digits."""
    seen: set[int] = set()
    phrases((text or "").encode("utf-8"), seen)
    return _hex(signature(seen))


class _Document:
    """A document parsed up to its edit, and whole."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.cut = len(text) // 2
        self.seen: set[int] = set()
        self.at = phrases(text[: len(text) - self.cut].encode("utf-8"), self.seen)
        whole = set(self.seen)
        phrases(text[len(text) - self.cut :].encode("utf-8"), whole, self.at)
        self.print = signature(whole)

    def row(self, following: str, next_print: np.ndarray) -> tuple:
        edit = following[: self.cut]
        phrases(edit.encode("utf-8"), self.seen, self.at)
        edited = signature(self.seen)
        digest = sha256((self.text[: len(self.text) - self.cut] + edit).encode("utf-8")).hexdigest()
        near = likeness(self.print, edited), likeness(self.print, next_print)
        return (self.doc_id, len(self.text), digest, _hex(self.print), _hex(edited), *near)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, last, doc_id, text) in order; ``last`` marks the row that follows the part and is not of it."""
    part, held = None, None
    names = [x.split()[0] for x in ROWS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        rows: list[tuple] = []
        for i in range(batch.num_rows):
            own, last, doc_id, text = (batch.column(k)[i].as_py() for k in range(4))
            if own != part:
                part, held = own, None
            elif last and held is None:
                continue  # the part's following row is known already
            now = _Document(doc_id, text or "")
            if held is not None:
                rows.append(held.row(now.text, now.print))
            held = None if last else now
        columns = [list(x) for x in zip(*rows, strict=True)] or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def with_following(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, last, doc_id, text), each part in one partition in order, ended by the first row of the next part.

    Parts are runs of ascending ids.  Only the parts' first rows, one per part, are sent to two places.
    """
    spark = docs.sparkSession
    bounds = id_bounds(docs, parts)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ids = ids.withColumn("part", part_of(F.col("doc_id"), bounds))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id"))
    heads = sorted((part, head.doc_id) for part, head in ids.groupBy("part").agg(first).collect())  # a row per part
    before = [heads[i - 1][0] for i in range(len(heads))]  # the first row of all follows the last part
    also = spark.createDataFrame([(h, p) for (_, h), p in zip(heads, before, strict=True)], "head bigint, before int")
    own = ids.join(F.broadcast(also), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    here = F.struct(F.col("part"), F.lit(False).alias("last"))
    there = F.struct(F.col("before").alias("part"), F.lit(True).alias("last"))
    places = F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))
    rows = own.select(F.explode(places).alias("place"), "doc_id", "text").select("place.part", "place.last", "doc_id", "text")
    rows = rows.repartitionById(len(bounds) + 1, "part")
    return rows.sortWithinPartitions("part", "last", "doc_id", "text")


def lz_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    return with_following(docs, parts or default_parts(docs)).mapInArrow(_prints, ROWS)


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprints(documents(spark, sf_dir))
