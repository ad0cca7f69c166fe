"""Operator 9: SimHash near-dedup by covering locality-sensitive hashing.

Every bit of a fingerprint has a non-zero vector of radius + 1 bits; table v keeps the bits whose vector has an odd
product with v.  Two fingerprints that differ in at most ``radius`` bits agree on all bits of some table, because
some v is orthogonal to the vectors of all the differing bits.  So 2^(radius+1) - 1 tables miss no pair.

A bucket of more than ``bucket`` different fingerprints isn't compared but dealt out again by the same rule over
the bits that its table left free.  Each time these are about half, so the third table's buckets are small by
construction.  Bucket mates give a spanning forest of their links, not all pairs.

Defined cases: equal fingerprints count once; texts without words (null, empty, white space) have fingerprint zero
and are linked with each other; a component of rows without ids has no id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.llm.common import documents, keep_rows, text_hash
from sightings.llm.components import components
from sightings.session import staged

BITS, RADIUS, WORDS, SEED = 64, 4, 4, 42
# Fingerprints that are compared at once in a bucket: 4 MB of distances.
BUCKET = 2000
LEVELS = 3


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """A hash for every run of so many words; a shorter text is one run."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "replace").lower().split()  # ASCII white space, ASCII case
    if not parts:
        return np.empty(0, "<u8")
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    last = ends[words - 1 :].tolist() or ends[-1:].tolist()
    shingles = [joined[a:b] for a, b in zip(starts, last)]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), "<u8", len(shingles))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """A bit is 1 if it is set in over half of the hashes of the text's shingles; signed, as Spark's bigint."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for begin in range(0, len(hashes), 100_000):
        some = hashes[begin : begin + 100_000]
        counts += np.unpackbits(some.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(text) for text in texts], dtype="int64")


def masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """The tables over the given bit positions: vectors are dealt in turn, so every table keeps about half."""
    span = (1 << (radius + 1)) - 1
    vectors = {bit: i % span + 1 for i, bit in enumerate(bits)}
    return [sum(1 << bit for bit, vector in vectors.items() if (vector & v).bit_count() & 1) for v in range(1, span + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _tables(kept: int, radius: int) -> list[int]:
    """Masks of the next level under a table that keeps the bits ``kept``; they keep these as well."""
    return [kept | m for m in masks([i for i in range(BITS) if not kept >> i & 1], radius)]


def _paths(level: int, radius: int) -> list[int]:
    """Masks of all tables of a level; a table's path is its place."""
    tables = [0]
    for _ in range(level):
        tables = [m for kept in tables for m in _tables(kept, radius)]
    return tables


def _forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of one bucket with the first member of their component inside the bucket."""
    near = np.empty((len(prints), len(prints)), bool)
    for begin in range(0, len(prints), 250):
        near[begin : begin + 250] = np.bitwise_count(prints[begin : begin + 250, None] ^ prints[None]) <= radius
    label = np.arange(len(prints), dtype=np.int32)
    while True:
        lower = np.concatenate([np.where(near[i : i + 250], label[None], len(prints)).min(1) for i in range(0, len(prints), 250)])
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower.astype(np.int32)
    child = np.flatnonzero(label != np.arange(len(prints)))
    return prints[child], prints[label[child]]


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (path, key, print) sorted by path and key: links inside each bucket, or the bucket's rows if over ``most``."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def told() -> Iterator[pa.RecordBatch]:
        if out:
            path, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.int32()), pa.array(a.view("<i8")), pa.array(b.view("<i8"))], ["path", "a", "b"])
            out.clear()

    def link(a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            out.append((np.full(len(a), -1, np.int32), a, b))

    def over(path: int, prints: np.ndarray) -> None:
        out.append((np.full(len(prints), path, np.int32), prints, prints))

    def close(bucket: tuple | None, held: list[np.ndarray], spilled: bool) -> None:
        if bucket is not None and not spilled and sum(map(len, held)) > 1:
            link(*_forest(np.concatenate(held), radius))

    bucket, held, spilled = None, [], False  # the bucket that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        path, key, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        prints = prints.view("<u8")
        starts = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (key[1:] != key[:-1])])
        ends = np.r_[starts[1:], len(path)]
        sizes = ends - starts
        for i in [0, *range(max(1, len(starts) - 1), len(starts))]:  # the first and the last run may be parts
            own = int(path[starts[i]]), int(key[starts[i]])
            if own != bucket:
                close(bucket, held, spilled)
                bucket, held, spilled = own, [], False
            held.append(prints[starts[i] : ends[i]])
            if most is not None and (spilled or sum(map(len, held)) > most):
                over(own[0], np.concatenate(held))
                held, spilled = [], True
            if i == 0 and len(starts) > 1:
                whole = slice(1, len(starts) - 1)
                two = starts[whole][sizes[whole] == 2]
                near = np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius
                link(prints[two + 1][near], prints[two][near])
                for j in np.flatnonzero(sizes[whole] > 2) + 1:
                    some = prints[starts[j] : ends[j]]
                    if most is not None and len(some) > most:
                        over(int(path[starts[j]]), some)
                    else:
                        link(*_forest(some, radius))
        yield from told()
    close(bucket, held, spilled)
    yield from told()


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) between different fingerprints of the column ``print`` that join what lies within the radius."""
    found = None
    todo = prints.select(F.lit(0).alias("path"), F.col("print").alias("a"))
    for level in range(1, LEVELS + 1):
        deal = partial(_deal, level=level, radius=radius)
        keys = todo.mapInArrow(deal, "path int, key bigint, print bigint")
        keys = keys.repartition("path", "key").sortWithinPartitions("path", "key")
        most = bucket if level < LEVELS else None
        link = partial(_bucket_links, radius=radius, most=most)
        made = staged(keys.mapInArrow(link, "path int, a bigint, b bigint"), f"bucket-links-{level}")
        near = made.where("path < 0").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
        found = near if found is None else found.unionByName(near)
        todo = made.where("path >= 0").select("path", "a")
        if level == LEVELS or todo.isEmpty():
            break
    return found


def _deal(batches: Iterator[pa.RecordBatch], level: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (path, a) to the tables below their path: at first all rows, then those of crowded buckets."""
    span = (1 << (radius + 1)) - 1
    below: dict[int, np.ndarray] = {}
    parents = _paths(level - 1, radius)
    for batch in batches:
        path, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        for one in np.unique(path):
            if one not in below:
                below[one] = np.array([_signed(m) for m in _tables(parents[one], radius)], np.int64)
            own = prints[path == one]
            keys = (own[:, None] & below[one][None]).ravel()
            paths = np.tile(int(one) * span + np.arange(span, dtype=np.int32), len(own))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.int32()), pa.array(keys), pa.array(np.repeat(own, span))], ["path", "key", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, print), written once: texts are read and hashed a single time."""
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.pandas_udf(_fingerprints, "bigint")(F.col("text")).alias("print"))
    return staged(rows, "fingerprints")


def groups(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(print, root) for every different fingerprint; root is the component's least fingerprint."""
    distinct = staged(prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).select("print"), "distinct-prints")
    roots = components(links(distinct, radius, bucket))
    linked = distinct.join(roots, F.col("print") == F.col("node"), "left")
    return linked.select("print", F.coalesce("root", "print").alias("root"))


def label(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """The rows of fingerprints() with component_id, the smallest id of their component."""
    root = staged(groups(prints, radius, bucket), "roots")
    least = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    named = root.join(least, "print")
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(root.join(first, "root").select("print", "component_id"), "print")


def drop_near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component stays, that of the smallest id (null last); docs' own columns."""
    prints = fingerprints(docs)
    root = groups(prints, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    own = prints.groupBy("print").agg(first.alias("first")).join(root, "print")
    kept = own.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash")
    return keep_rows(docs, kept, text_hash(F.col("text")), "doc_id", "text_hash")


def hex_print(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = label(fingerprints(documents(spark, sf_dir)))
    return out.select("doc_id", hex_print(F.col("print")).alias("fingerprint"), "component_id")
