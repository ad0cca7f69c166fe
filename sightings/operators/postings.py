"""Full-text search over a postings table: BM25 ranks, and only the blocks of the query's terms that can matter are read.

Documents are numbered by length and cut into blocks of ``BLOCK`` numbers.  A posting is a term, a document number and
how often the document has the term.  A task counts the words of its documents where it has them, and a row holds the
postings of a term in a block as lists (several rows where tasks share a block), so few rows are shuffled and sorted.
They lie in folders by a hash of the term, sorted by term and block, so that a query reads its terms' buckets and,
inside them, their rows.  For every term and block the table of bounds has the largest weight that a document of the
block can get from the term.

A search adds the bounds of its terms block by block.  The exact scores of the best blocks give a score that the k-th
result has at least; only blocks whose bound reaches it are read then.  Nothing is lost: a bound is never below a score.

Documents are added in segments; bounds use a segment's own postings and the statistics of all segments.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import partial, reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.operators.text_search import tokens_of
from sightings.operators.tree_intervals import places
from sightings.session import staged
from sightings.sources.versions import VersionLog

# The usual saturation of repeated terms and weight of the length.
K1, B = 1.2, 0.75
# Scores are rounded to so many digits, so that equal documents have equal scores whatever the order of their sums.
DIGITS = 9
# Documents of a block, folders of postings, and blocks that give the first bound.
BLOCK, BUCKETS, FIRST_BLOCKS = 4096, 64, 8
# Words that a task counts at once, about, rows of an Arrow batch that it hands back, and documents of a task
# where a table of few files is spread.
WORDS, ROWS, TASK_ROWS = 2_000_000, 10_000, 50_000

_DOCUMENTS = "number bigint, docid string, length bigint"
_LISTS = "term string, block bigint, numbers array<bigint>, tfs array<int>, lengths array<bigint>, df bigint, tf int, least_length bigint"
_POSTINGS = f"{_LISTS}, bucket int"
_BOUNDS = "term string, block bigint, df bigint, tf int, least_length bigint, bucket int"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def all_words(text: Column) -> Column:
    """Lower-case words of a text in order, repeats included."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def idf(documents: int, df: Column) -> Column:
    return F.log(1 + (documents - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, average: float) -> Column:
    """What repeats of a term are worth in a document of a length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _postings_of(number: np.ndarray, length: np.ndarray, words: pa.StringArray, block: int) -> Iterator[pa.RecordBatch]:
    """Rows of a term and a block with the postings of some documents, in the order of their numbers."""
    lists = pc.split_pattern(words, " ")
    terms = lists.flatten().dictionary_encode()
    order = np.argsort(number, kind="stable")
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    owner = at[pc.list_parent_indices(lists).to_numpy()]
    # a pair of term and document as one number: equal ones are repeats
    pairs, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * len(order) + owner, return_counts=True)
    term, document = np.divmod(pairs, len(order))
    number, length = number[order][document], length[order][document]
    blocks = (number - 1) // block
    starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (blocks[1:] != blocks[:-1])])
    offsets = pa.array(np.r_[starts, len(pairs)].astype(np.int32))
    columns = [
        terms.dictionary.take(pa.array(term[starts])),
        pa.array(blocks[starts]),
        *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (number, tf.astype(np.int32), length)],
        pa.array(np.diff(np.r_[starts, len(pairs)])),
        pa.array(np.maximum.reduceat(tf, starts).astype(np.int32)),
        pa.array(np.minimum.reduceat(length, starts)),
    ]
    rows = pa.RecordBatch.from_arrays(columns, ["term", "block", "numbers", "tfs", "lengths", "df", "tf", "least_length"])
    for begin in range(0, len(rows), ROWS):
        yield rows.slice(begin, ROWS)


def _counted(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """(number, length, words) of documents that have words to rows of postings."""
    held: list[pa.RecordBatch] = []
    size = 0

    def closed() -> Iterator[pa.RecordBatch]:
        some = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield from _postings_of(some.column(0).to_numpy(), some.column(1).to_numpy(), some.column(2), block)

    for batch in batches:
        if len(batch):
            held.append(batch)
            size += pc.sum(batch.column(1)).as_py()
        if size >= WORDS:
            yield from closed()
            held, size = [], 0
    if held:
        yield from closed()


def _spread(docs: DataFrame) -> DataFrame:
    """Texts that lie in fewer files than there are cores are split into words by more tasks than read them."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if len(docs.inputFiles()) >= cores:
        return docs
    return docs.repartition(max(cores, math.ceil(docs.count() / TASK_ROWS)))


class PostingsIndex:
    """An index of texts at a path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, block: int = BLOCK):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = VersionLog(spark, f"{self.path}/log")
        current = self.log.current()  # an index keeps the measures that it was made with
        self.buckets, self.block = (current.entry["buckets"], current.entry["block"]) if current else (buckets, block)

    def segments(self) -> list[dict]:
        current = self.log.current()
        return current.entry["segments"] if current else []

    def add(self, docs: DataFrame, doc_id: str, text: Column) -> None:
        """Adds documents as a segment; a null text has no words and is found by nothing."""
        current = self.log.current()
        folder = f"{self.path}/segment-{uuid.uuid4().hex}"
        own = _spread(docs.select(F.col(doc_id).cast("string").alias("docid"), F.coalesce(text, F.lit("")).alias("text")))
        split = own.select("docid", all_words(F.col("text")).alias("words"))
        # split once and staged; the words, which hold no space, move as one text, a third of their size as an array
        own = staged(split.select("docid", F.size("words").cast("bigint").alias("length"), F.array_join("words", " ").alias("words")), "words")
        numbered = places(own.withColumn("by_length", F.struct("length", "docid")), "by_length", "number").drop("by_length")
        numbered.select("number", "docid", "length").write.parquet(f"{folder}/documents")
        postings = numbered.where("length > 0").select("number", "length", "words").mapInArrow(partial(_counted, block=self.block), _LISTS)
        # a frequent term's postings are dealt out by block as well: no task has all of them
        dealt = postings.withColumn("bucket", bucket_of(F.col("term"), self.buckets)).repartition("bucket", F.pmod("block", F.lit(16)))
        dealt.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{folder}/postings")
        rows = self.spark.read.schema(_POSTINGS).parquet(f"{folder}/postings")
        of_block = rows.groupBy("bucket", "term", "block").agg(F.sum("df").alias("df"), F.max("tf").alias("tf"), F.min("least_length").alias("least_length"))
        of_block.repartition("bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{folder}/bounds")
        sums = self.spark.read.schema(_DOCUMENTS).parquet(f"{folder}/documents").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        segments = [*self.segments(), {"folder": folder, "documents": sums.n, "words": sums.words}]
        self.log.commit({"segments": segments, "buckets": self.buckets, "block": self.block}, current.number if current else None)

    def _read(self, kind: str, schema: str, words: list[str]) -> DataFrame:
        """Rows of the words' buckets, of all segments; ``segment`` is its place in the list."""
        numbers = self.spark.createDataFrame([(w,) for w in words], "w string").select(bucket_of(F.col("w"), self.buckets)).distinct().collect()
        parts = [self.spark.read.schema(schema).parquet(f"{s['folder']}/{kind}").withColumn("segment", F.lit(k)) for k, s in enumerate(self.segments())]
        return reduce(DataFrame.unionByName, parts).where(F.col("bucket").isin([r[0] for r in numbers]) & F.col("term").isin(words))

    def _scores(self, words: list[str], weights: dict[str, float], average: float, blocks: Column) -> DataFrame:
        return self._scored(self._read("postings", _POSTINGS, words).where(blocks), weights, average)

    def _scored(self, rows: DataFrame, weights: dict[str, float], average: float) -> DataFrame:
        """Exact scores from rows of postings."""
        one = F.explode(F.arrays_zip("numbers", "tfs", "lengths")).alias("one")
        rows = rows.select("segment", "term", one).select("segment", "term", F.col("one.numbers").alias("number"), "one.tfs", "one.lengths")
        weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        worth = weight[F.col("term")] * saturation(F.col("tfs"), F.col("lengths"), average)
        return rows.groupBy("segment", "number").agg(F.round(F.sum(worth), DIGITS).alias("score"))

    def search(self, query: str, k: int = 10) -> DataFrame:
        """(docid, score) of the k best documents, the best first, ties by id."""
        words, segments = tokens_of(query), self.segments()
        documents, total = sum(s["documents"] for s in segments), sum(s["words"] for s in segments)
        none = self.spark.createDataFrame([], "docid string, score double")
        if not words or not total:
            return none
        average = total / documents
        bounds = staged(self._read("bounds", _BOUNDS, words), "bounds")
        df = {r.term: r.n for r in bounds.groupBy("term").agg(F.sum("df").alias("n")).collect()}  # a row a word of the query
        if not df:
            return none
        weights = {r.w: r.v for r in self.spark.createDataFrame(list(df.items()), "w string, n bigint").select("w", idf(documents, F.col("n")).alias("v")).collect()}
        weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        most = weight[F.col("term")] * saturation(F.col("tf"), F.col("least_length"), average)
        of_block = staged(bounds.groupBy("segment", "block").agg((F.sum(most) * (1 + 1e-9) + 10.0**-DIGITS).alias("most")), "block-bounds")
        first = of_block.orderBy(F.desc("most"), "segment", "block").limit(FIRST_BLOCKS).collect()
        in_first = reduce(or_, [(F.col("segment") == r.segment) & (F.col("block") == r.block) for r in first])
        best = staged(self._top(self._scores(list(df), weights, average, in_first), k), "first-results")
        scores = [r.score for r in best.select("score").collect()]  # k rows at most
        least = min(scores) if len(scores) == k else 0.0
        rest = of_block.where((F.col("most") >= least) & ~in_first)
        later = self._scores_of(list(df), weights, average, rest)
        found = self._top(best.unionByName(self._top(later, k, named=True)), k, named=False) if later is not None else best
        return found.select("docid", "score").orderBy(F.desc("score"), "docid")

    def _scores_of(self, words: list[str], weights: dict[str, float], average: float, blocks: DataFrame) -> DataFrame | None:
        """Scores in the blocks of a table; a few of them as comparisons at the scan, many as a semi join."""
        some = blocks.select("segment", "block").limit(201).collect()
        if not some:
            return None
        if len(some) <= 200:
            chosen = reduce(or_, [(F.col("segment") == s) & F.col("block").isin([r.block for r in some if r.segment == s]) for s in sorted({r.segment for r in some})])
            return self._scores(words, weights, average, chosen)
        rows = self._read("postings", _POSTINGS, words).join(blocks.select("segment", "block"), ["segment", "block"], "left_semi")
        return self._scored(rows, weights, average)

    def _top(self, scores: DataFrame, k: int, named: bool = True) -> DataFrame:
        """(docid, score) of the k best; documents of the k-th score are all named before ties are cut by id."""
        if named:
            parts = [self.spark.read.schema(_DOCUMENTS).parquet(f"{s['folder']}/documents").withColumn("segment", F.lit(n)) for n, s in enumerate(self.segments())]
            least = scores.orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("least"))
            likely = scores.join(F.broadcast(least), F.col("score") >= F.col("least"))  # one row
            scores = reduce(DataFrame.unionByName, parts).join(likely, ["segment", "number"]).select("docid", "score")
        return scores.orderBy(F.desc("score"), "docid").limit(k)
