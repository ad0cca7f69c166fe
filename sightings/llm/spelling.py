"""Operator 13: spelling variants of a corpus's words, by dense prefix-suffix tiling.

Two words are near if one edit of one code point (inserted, deleted, replaced) turns one into the other.  With p code
points in common at the start and s at the end that is p + s >= L - 1, where L is the longer one's length.  Blocks of
words become two matrices of code points, padded behind and before; a block pair is compared column by column, all
words against all words, which gives p and s of every pair at once.

Not all blocks are compared.  The edit stands at some place of the longer word; the places are cut into windows, and
for the window that holds it both words agree before and behind the window.  So words are dealt to buckets by length
class, window and what stands outside it: near words meet in the bucket of their edit's window, and whole buckets
fill the blocks.  A bucket of more than ``MOST`` words is not compared but dealt out again by half windows; a window of
one place holds as many words as there are letters, so this ends.  Pairs leave a task only if they are near.

A word's form is its near word of largest count if that is five times its own or more; counts rise along forms, so
the root is found by doubling, in about log2 of the longest chain.

Defined cases: null texts have no words; a null id counts as the empty text in the hash; repeated rows count again;
without words the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.llm.common import documents
from sightings.session import staged

LETTERS, UPPER, LOWER = r"A-Za-zÀ-ÿ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EVERY, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
# Places of a window at first, and windows of a word at most.
WINDOW, WINDOWS = 3, 8
# Words of a bucket that are compared at once, words of a block, and code points of a block's matrix.
MOST, BLOCK, CELLS = 2000, 128, 1 << 22


def runs(docs: DataFrame) -> DataFrame:
    """The column ``word``: the words of all texts, those that the hash picks without one code point.

    Only runs of the least length or more can give a word, so shorter ones are passed over.
    """
    found = F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{LEAST_LENGTH},}})"), F.lit(1))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(found).alias("run"))
    rows = rows.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    place = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substr("run", place + 2))
    return rows.withColumn("h", h).select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    counted = runs(docs).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return staged(counted.where(F.col("n") >= LEAST_COUNT), "words")


def _key(word: Column, size: Column, begin: Column, end: Column) -> Column:
    """A hash of the class, the window and what the word has outside it."""
    before, behind = F.substring(word, F.lit(1), begin), F.expr("right(word, size - end)")
    return F.xxhash64(size, begin, end, before, behind)


def deal(counted: DataFrame, window: int = WINDOW, most: int = WINDOWS) -> DataFrame:
    """(size, begin, end, key, word, n): every word in its own length class and as the shorter one in the next."""
    length = F.length("word")
    classes = counted.select("word", "n", F.explode(F.array(length, length + 1)).alias("size"))
    windows = F.least(F.ceil(F.col("size") / window).cast("int"), F.lit(most))
    each = classes.withColumn("windows", windows).withColumn("w", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)))
    cut = lambda w: F.floor(F.col("size") * w / F.col("windows")).cast("int")
    placed = each.select("word", "n", "size", cut(F.col("w")).alias("begin"), cut(F.col("w") + 1).alias("end"))
    return placed.select("size", "begin", "end", _key(F.col("word"), F.col("size"), F.col("begin"), F.col("end")).alias("key"), "word", "n")


def _halves(crowded: DataFrame) -> DataFrame:
    """The rows of crowded buckets, in the buckets of both halves of their window."""
    middle = F.floor((F.col("begin") + F.col("end")) / 2).cast("int")
    parts = F.array(F.struct("begin", middle.alias("end")), F.struct(middle.alias("begin"), "end"))
    rows = crowded.select("size", "word", "n", F.explode(parts).alias("part")).select("size", "word", "n", "part.begin", "part.end")
    return rows.select("size", "begin", "end", _key(F.col("word"), F.col("size"), F.col("begin"), F.col("end")).alias("key"), "word", "n")


def matrices(some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words, padded behind and padded before, a column for each place, and the lengths."""
    sizes = np.fromiter(map(len, some), np.int32, len(some))
    width = int(sizes.max())
    points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4")
    row, offset = np.repeat(np.arange(len(some)), sizes), np.cumsum(sizes) - sizes
    column = np.arange(len(points)) - offset[row]
    left, right = np.zeros((width, len(some)), "<u4"), np.zeros((width, len(some)), "<u4")
    left[column, row] = points
    right[(sizes[row] - 1 - column), row] = points
    return left, right, sizes


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading columns every word of one matrix has in common with every word of the other."""
    alive = a[0][:, None] == b[0][None, :]
    out = alive.astype(np.int32)
    for k in range(1, min(len(a), len(b))):
        alive &= a[k][:, None] == b[k][None, :]
        if not alive.any():
            break
        out += alive
    return out


def near(a: list[str], b: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the words that are one edit apart, in two blocks, or in one, where i < j."""
    one = matrices(a)
    other = one if b is None else matrices(b)
    longer = np.maximum(one[2][:, None], other[2][None, :])
    close = _common(one[0], other[0]) + _common(one[1], other[1]) >= longer - 1
    close &= np.abs(one[2][:, None] - other[2][None, :]) <= 1
    i, j = np.nonzero(np.triu(close, 1) if b is None else close)
    differ = np.fromiter((a[x] != (a if b is None else b)[y] for x, y in zip(i, j)), bool, len(i))
    return i[differ], j[differ]


_FOUND = "size int, begin int, end int, u string, n_u bigint, v string, n_v bigint"
Word = tuple[str, int]


def _buckets(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[tuple[int, int, int], list[Word], bool]]:
    """(class and window, words, crowded) of rows sorted by class and key; a crowded bucket comes in several parts."""
    own, held, crowded = None, [], False
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for size, begin, end, key, word, n in zip(*columns, strict=True):
            bucket = (size, begin, end, key)
            if bucket != own:
                if held:
                    yield own[:3], held, crowded
                own, held, crowded = bucket, [], False
            held.append((word, n))
            if len(held) > most and end - begin > 1:
                yield own[:3], held, True
                held, crowded = [], True
    if held:
        yield own[:3], held, crowded


def _compare(batches: Iterator[pa.RecordBatch], most: int, block: int) -> Iterator[pa.RecordBatch]:
    """Near pairs (u before v) of all buckets, and the words of crowded buckets with their window."""
    out: list[tuple] = []

    def told(least: int) -> Iterator[pa.RecordBatch]:
        if len(out) >= least:
            types = [pa.int32()] * 3 + [pa.string(), pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["size", "begin", "end", "u", "n_u", "v", "n_v"])
            out.clear()

    def pairs(a: list[Word], b: list[Word] | None = None) -> None:
        i, j = near([w for w, _ in a], None if b is None else [w for w, _ in b])
        other = a if b is None else b
        out.extend((None, None, None, *min(a[x], other[y]), *max(a[x], other[y])) for x, y in zip(i.tolist(), j.tolist()))

    def compare(some: list[Word]) -> None:
        """All block pairs of the words, which stand for one bucket or for several small ones."""
        step = max(2, min(block, CELLS // max(len(w) for w, _ in some)))
        tiles = [some[k : k + step] for k in range(0, len(some), step)]
        for k, tile in enumerate(tiles):
            pairs(tile)
            for other in tiles[k + 1 :]:
                pairs(tile, other)

    pool: list[Word] = []
    pool_size = 0
    for (size, begin, end), some, crowded in _buckets(batches, most):
        if crowded:
            out.extend((size, begin, end, w, n, None, None) for w, n in some)
        elif len(some) > 1:
            if pool and (size != pool_size or len(pool) + len(some) > block):
                compare(pool)
                pool = []
            pool, pool_size = pool + some, size
        yield from told(10_000)
    if pool:
        compare(pool)
    yield from told(1)


def near_pairs(counted: DataFrame, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(u, n_u, v, n_v), u before v, of all near words; each pair once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compare(batches, most, block)

    found, todo = None, deal(counted)
    while True:
        sorted_rows = todo.repartition("key").sortWithinPartitions("size", "begin", "end", "key")
        made = staged(sorted_rows.mapInArrow(task, _FOUND), "near-words")
        pairs = made.where("size is null").select("u", "n_u", "v", "n_v")
        found = pairs if found is None else found.unionByName(pairs)
        crowded = made.where("size is not null").select("size", "begin", "end", F.col("u").alias("word"), F.col("n_u").alias("n"))
        if crowded.isEmpty():
            return staged(found.distinct(), "near-pairs")
        todo = _halves(crowded)


def forms(counted: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("n_v").alias("n_u"), F.col("u").alias("v"), F.col("n_u").alias("n_v")))
    best = F.min(F.struct((-F.col("n_v")).alias("minus"), "v")).alias("best")
    of = both.groupBy(F.col("u").alias("near_word")).agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = counted.join(of, F.col("word") == F.col("near_word"), "left")
    is_form = -F.col("best.minus") >= ratio * F.col("n")
    return staged(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                      F.when(is_form, F.col("best.v")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")), "forms",
    )


def roots(with_forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: its form's form and so on, twice as far in every round."""
    links = with_forms.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        joined = links.join(onward, F.col("root") == F.col("at"), "left")
        links = staged(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def variants(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts."""
    counted = words(docs)
    known = forms(counted, near_pairs(counted, most))
    root = roots(known).withColumnRenamed("word", "from_word")
    out = known.join(root, F.col("word") == F.col("from_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))
