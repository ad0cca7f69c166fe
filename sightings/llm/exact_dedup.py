"""Operator 10: exact dedup by a persistent digest index, with DataFrame functions only.

The index is a table bucketed and sorted by digest.  A batch of documents is reduced to one row per digest, an
anti-join by sort and merge drops the digests that the index has, and the rest is appended.  The index is read in
its buckets, so only the new side is shuffled.  Texts never travel: a row is an id and 32 bytes.

The number of buckets is kept at the index's path, in a log of its versions, and an index that is opened again has the
buckets that it was written with.  Every append adds a file to each bucket; after ``APPENDS`` of them the index is
written anew as the next version, one sorted file a bucket, and the log names that version when it is whole.  One
session writes an index at a time.

Defined cases: a null text is empty, and empty texts are equal.  The smallest id of a group stays, a null id comes
last, and of several rows with that id one stays.  Empty tables give empty results; other columns are not touched.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.llm.common import documents, keep_rows
from sightings.session import shared_folder, staged

# Digests a bucket should hold at most: about 200 MB, sorted within one task's memory.
BUCKET_ROWS = 4_000_000
# Files of a bucket after which the index is written anew.
APPENDS = 16
_LOG = "version int, buckets int"


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, digest), written once: texts are read a single time, and row numbers stay as they are."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest(F.col("text")).alias("digest"))
    return staged(rows, "digests")


def first_rows(rows: DataFrame) -> DataFrame:
    """One row per digest: who stays (id and row), and how many rows there are."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = rows.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    return groups.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size")


class DigestIndex:
    """A table (digest, keep_id) bucketed and sorted by digest; it outlives the session at its path.

    ``buckets`` is for a new index; one that is there already keeps its own number, see ``rewrite`` for another.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark = spark
        self.path = path or f"{shared_folder(spark)}/digest-index-{uuid.uuid4().hex}"
        if not (path and self._log()):
            self._commit(0, buckets)
        self._open()

    def _log(self) -> list[tuple[int, int]]:
        """(version, buckets) of all whole versions; a row per rewriting."""
        try:
            rows = self.spark.read.schema(_LOG).parquet(f"{self.path}/log").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(tuple(r) for r in rows)

    def _commit(self, version: int, buckets: int) -> None:
        self.spark.createDataFrame([(version, buckets)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _table(self, version: int, buckets: int) -> str:
        name = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT) USING parquet LOCATION '{self.path}/v{version}' "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
        )
        return name

    def _open(self) -> None:
        self.version, self.buckets = self._log()[-1]
        self.table = self._table(self.version, self.buckets)

    def rewrite(self, buckets: int | None = None) -> None:
        """The next version: the same rows, in one sorted file a bucket, with another number of buckets if wanted."""
        buckets = buckets or self.buckets
        rows, following = self.read(), self._table(self.version + 1, buckets)
        self._write(rows, following, buckets)
        self._commit(self.version + 1, buckets)
        self._open()

    @classmethod
    def for_rows(cls, spark: SparkSession, rows: int) -> DigestIndex:
        """A new index of as many buckets as so many rows ask for: a power of two, eight at least."""
        return cls(spark, buckets=max(8, 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length()))

    @staticmethod
    def _write(rows: DataFrame, table: str, buckets: int) -> None:
        rows = rows.select("digest", F.col("keep_id").cast("bigint").alias("keep_id")).repartition(buckets, "digest")
        rows.write.bucketBy(buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def new(self, groups: DataFrame) -> DataFrame:
        """Groups whose digest the index lacks: a sort-merge anti-join against its buckets."""
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        self._write(groups, self.table, self.buckets)
        if len(self.read().inputFiles()) > APPENDS * self.buckets:
            self.rewrite()

    def add(self, groups: DataFrame) -> DataFrame:
        """Appends what is new and returns it; written before it is appended, so that it does not meet itself."""
        fresh = staged(self.new(groups), "new-digests")
        self.append(fresh)
        return fresh


def deduplicate(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The documents come to the index in ``batches`` ranges of ascending ids, as they would arrive; the result is the
    same for any number.  With an index that has older data, keep_id may be an id of that.
    """
    rows = digests(docs)
    index = index or DigestIndex.for_rows(spark, rows.count())
    cuts = rows.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    fresh = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        here = F.lit(True) if low is None else F.coalesce(F.col("doc_id") >= low, F.lit(True))
        here = here if high is None else here & (F.col("doc_id") < high)
        new = index.add(first_rows(rows.where(here))).select("digest", "keep_row")
        fresh = new if fresh is None else fresh.unionByName(new)
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = sizes.join(index.read().hint("merge"), "digest").join(fresh, "digest", "left")
    out = rows.hint("merge").join(groups, "digest")
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without exact copies, in their own columns: one row of every group of equal texts."""
    rows = digests(docs)
    index = DigestIndex.for_rows(spark, rows.count())
    kept = index.add(first_rows(rows)).select("digest", "keep_id")
    never_null = F.coalesce(digest(F.col("text")), F.lit(b""))  # else the planner would test it for null, computing it twice
    return keep_rows(docs, kept, never_null, "keep_id", "digest")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark, documents(spark, sf_dir))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
