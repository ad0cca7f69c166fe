"""Operator 11: whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Three passes read the vectors and a fourth writes the result, none shuffles them: exact whole-number sums by dimension; the scatter of the centred
vectors; the scatter of the whitened ones, which tells how far their covariance is from the identity.  A task adds
up its own rows and gives back one sum of dimension squared numbers; these are added up by rows of the matrix in as
many tasks as there are rows.  What reaches the driver is one matrix, whatever the number of vectors.

There the scatter is factored into a triangular factor L by Cholesky with the largest remaining diagonal entry as the
pivot, which ends at the rank.  Jacobi rotations from the right make L's columns orthogonal: V = L L^T = (L J)(L J)^T,
so the squared norms of the rotated columns are V's eigenvalues and the normalised columns its eigenvectors.

Whole numbers: x = floor(1024 c) + 100000 for an entry c.  All centring starts from n x - S, which is exact.

Defined cases: a row goes if its vector is null, empty, holds a null or a non-finite entry, or is not as long as most
vectors are (ties: the longer).  Repeated rows and ids, null ids too, each count and are returned.  Vectors that
span fewer than the wanted dimensions, such as one vector alone, have as many components as their rank; without any
the result is empty, as for an empty table.  A deviation beyond a long's range is null.  Components have their
largest entry (the first of equal ones) positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.llm.common import prepare, unused

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
# Sweeps of rotations over all pairs of columns; they end when no pair is further from orthogonal than rounding.
SWEEPS = 60


def usable(vector: Column) -> Column:
    """True where the vector is there and all its entries are finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def whole(flat: np.ndarray, width: int, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """The vectors' whole numbers, a row each; Python's integers where a long would be too short for sums of them."""
    found = np.floor(flat.astype(np.float64) * scale)
    if not len(found) or np.abs(found).max() < 2.0**40:
        return (found.astype(np.int64) + shift).reshape(-1, width)
    exact = [floor(Fraction(float(c)) * scale) + shift for c in flat]
    return np.array(exact, object).reshape(-1, width)


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("vector"))
    return whole(column.flatten().to_numpy(zero_copy_only=False), width)


def _deviations(x: np.ndarray, n: int, sums: list[int], most: float) -> np.ndarray:
    """n x - S, exactly: as longs where these do for entries of at most this size, as Python's integers otherwise."""
    total = np.array(sums, object)
    if x.dtype != object and 2 * n * most < 2**62:
        return n * x - total.astype(np.int64)
    return n * x.astype(object) - total


def _centred(deviation: np.ndarray, n: int, unit: float) -> np.ndarray:
    """x - S/n in units, in doubles; the numerator is exact."""
    if deviation.dtype == object and unit > 1:
        return (deviation // int(unit)).astype(np.float64) / n
    return deviation.astype(np.float64) / n / unit


def squares(deviation: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly; None beyond a long."""
    if deviation.dtype == object:
        found = (deviation * deviation).sum(1).tolist()
        return [v if v < 2**63 else None for v in found]
    about = (deviation.astype(np.float64) ** 2).sum(1)
    exact = np.where(about[:, None] < 2.0**62, deviation, 0)
    out: list[int | None] = (exact * exact).sum(1).tolist()
    for k in np.flatnonzero(about >= 2.0**62):
        value = sum(int(v) * int(v) for v in deviation[k]) if about[k] < 2.0**64 else 2**63
        out[k] = value if value < 2**63 else None
    return out


def _matrix_sums(batches: Iterator[pa.RecordBatch], width: int, own: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(i, entries): the rows of the sum of z^T z over the task's vectors, where z = own(x)."""
    total = None
    for batch in batches:
        if batch.num_rows:
            z = own(_vectors(batch, width))
            total = z.T @ z if total is None else total + z.T @ z
    if total is not None:
        rows = pa.array(total.tolist(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), rows], ["i", "entries"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, entries) of many tasks to their sums; a task holds one row of the matrix for each i dealt to it."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, entries in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = entries.values.to_numpy()
            sums[i] = sums[i] + own if i in sums else own.copy()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["i", "entries"])


def _whole_matrix(vectors: DataFrame, size: int, width: int, own: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _matrix_sums(batches, width, own)

    parts = vectors.select("vector").mapInArrow(task, "i int, entries array<double>")
    rows = parts.repartition("i").mapInArrow(_added, "i int, entries array<double>").collect()
    out = np.zeros((size, size))
    for row in rows:
        out[row.i] = row.entries
    return out


_TOTALS = "i int, n bigint, total string, most double"


def _total_rows(totals: dict[int, tuple[int, int, float]]) -> pa.RecordBatch:
    """Whole numbers of any size, as text."""
    n, total, most = zip(*totals.values(), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(n, pa.int64()), pa.array(map(str, total), pa.string()), pa.array(most, pa.float64())], ["i", "n", "total", "most"])


def _sum_task(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(i, n, total, most) by dimension: the task's rows, their exact sum, and their largest size."""
    n, total, most = 0, np.zeros(width, object), np.zeros(width)
    for batch in batches:
        if batch.num_rows:
            x = _vectors(batch, width)
            n += len(x)
            total = total + x.sum(0).astype(object)
            most = np.maximum(most, np.abs(x).max(0).astype(np.float64))
    if n:
        yield _total_rows({i: (n, int(total[i]), float(most[i])) for i in range(width)})


def _added_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, tuple[int, int, float]] = {}
    for batch in batches:
        for i, n, total, most in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = sums.get(i, (0, 0, 0.0))
            sums[i] = own[0] + n, own[1] + int(total), max(own[2], most)
    if sums:
        yield _total_rows(sums)


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """A factor L of a positive semidefinite matrix, with a column for each dimension that it spans: matrix = L L^T.

    The row with the largest remaining diagonal entry comes next; the end is where what remains is rounding.  L is
    triangular in the order of the pivots; its rows stand in the matrix's own order.
    """
    size = len(matrix)
    left = matrix.diagonal().astype(np.float64).copy()
    factor = np.zeros((size, size))
    open_rows = np.ones(size, bool)
    least = size * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for k in range(size):
        pivot = int(np.argmax(np.where(open_rows, left, -np.inf)))
        if not left[pivot] > least:
            return factor[:, :k]
        open_rows[pivot] = False
        root = np.sqrt(left[pivot])
        column = np.where(open_rows, (matrix[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / root, 0.0)
        column[pivot] = root
        factor[:, k] = column
        left = left - column**2
    return factor


def _pairings(many: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds in which every column meets one other, until all have met, as in a tournament."""
    ring = list(range(many + many % 2))
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        met = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:])) if a < many and b < many]
        yield np.array([a for a, _ in met], int), np.array([b for _, b in met], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(factor: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of factor factor^T by rotating the factor's columns."""
    g = factor.copy()
    near = np.finfo(float).eps
    for _ in range(sweeps):
        worst = 0.0
        for p, q in _pairings(g.shape[1]):
            if not len(p):
                continue
            a, b = g[:, p], g[:, q]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            norm = np.sqrt(alpha * beta)
            off = np.where(norm > 0, np.abs(gamma) / np.where(norm > 0, norm, 1), 0.0)
            worst = max(worst, float(off.max()))
            turn = off > near
            zeta = (beta - alpha) / (2 * np.where(turn, gamma, 1.0))
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = np.where(turn, 1 / np.sqrt(1 + t * t), 1.0)
            s = np.where(turn, c * t, 0.0)
            g[:, p], g[:, q] = c * a - s * b, s * a + c * b
        if worst <= 4 * near:
            break
    values = (g * g).sum(0)
    order = np.argsort(-values, kind="stable")
    values, g = values[order], g[:, order]
    vectors = g / np.sqrt(values)
    lead = np.argmax(np.abs(vectors) > np.abs(vectors).max(0) * (1 - 1e-9), axis=0)
    return values, vectors * np.sign(vectors[lead, np.arange(len(lead))])


@dataclass
class Whitening:
    """What the fit learned: n, the sums by dimension, the leading eigenvalues and components, and how well they whiten.

    Eigenvalues and trace are in squared units; a unit is 1 unless entries are so large that squares wouldn't do.
    """

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    unit: float
    most: float
    identity_error: float = 0.0

    @property
    def width(self) -> int:
        return len(self.sums)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        return _deviations(x, self.n, self.sums, self.most)

    def project(self, deviation: np.ndarray) -> np.ndarray:
        return _centred(deviation, self.n, self.unit) @ self.components / np.sqrt(self.values)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.project(self.deviations(x))


def remaining(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """The rows that count, with their vector as doubles in the column ``vector``, and its length; 0 without any."""
    own = rows.withColumn("vector", F.col(vector).cast("array<double>")).where(usable(F.col("vector")))
    lengths = own.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("rows"))
    most = lengths.orderBy(F.desc("rows"), F.desc("width")).limit(1).collect()
    width = most[0].width if most else 0
    return own.where(F.size("vector") == width), width


def fit(vectors: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the column ``vector``, all of one length; None if there is no vector."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sum_task(batches, width)

    parts = vectors.select("vector").mapInArrow(sums, _TOTALS).repartition("i")
    found = {r.i: r for r in parts.mapInArrow(_added_totals, _TOTALS).collect()}
    if not found:
        return None
    n, totals = found[0].n, [int(found[i].total) for i in range(width)]
    most = max(r.most for r in found.values())
    unit = 2.0 ** int(np.log2(most)) if most > 1e100 else 1.0
    scatter = _whole_matrix(vectors, width, width, lambda x: _centred(_deviations(x, n, totals, most), n, unit))
    values, axes = jacobi(pivoted_cholesky(scatter))
    many = min(components, len(values))
    model = Whitening(n, totals, values[:many] / n, np.ascontiguousarray(axes[:, :many]), float(np.trace(scatter)) / n, unit, most)
    if many:
        covariance = _whole_matrix(vectors, many, width, model.whiten) / n
        model.identity_error = float(np.abs(covariance - np.eye(many)).max())
    return model


def whitened(vectors: DataFrame, model: Whitening, row_id: str = "vec_id") -> DataFrame:
    """(row_id, deviation, whitened array) for every row, in one pass without a shuffle."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # dimension times components numbers

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fitted = shared.value
                deviation = fitted.deviations(_vectors(batch, fitted.width))
                z = fitted.project(deviation)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squares(deviation), pa.int64()), lists], [row_id, "deviation", "whitened"])

    id_type = vectors.schema[row_id].dataType.simpleString()
    return vectors.select(row_id, "vector").mapInArrow(task, f"{row_id} {id_type}, deviation bigint, whitened array<double>")


_RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining row and component."""
    spark = rows.sparkSession
    vectors, width = remaining(rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding")))
    model = fit(vectors, width, components) if width else None
    if model is None or not len(model.values):
        return spark.createDataFrame([], _RESULT)
    place, value = unused(["vec_id", "deviation"], "place", "value")
    by_component = whitened(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias(place, value))
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return by_component.select(
        "vec_id", (F.col(place) + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation",
        F.col(value).alias("whitened"), F.get(shares, F.col(place)).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))
